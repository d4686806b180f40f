"""Connected components of a link table, by contraction: DataFrame steps, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (long ids, any direction, repeats allowed).

    Each round every node points to its neighbour of least priority (a hash that changes each round, so that no order
    of ids makes long chains), pointers are followed twice, and the links are rewritten to the nodes they lead to. The
    links left shrink by a constant factor a round; minima are pre-aggregated, so a hub with any number of links is one key.
    Null ends and links of a node to itself are ignored.
    """
    left = written(_undirected(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))), "links")
    found, turn = None, 0
    while not left.isEmpty():
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = written(least.select(F.col("a").alias("node"), F.when(F.col("m") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("to")), "to")
        first, to = to, written(_follow(_follow(to, to), to), "to")
        discard(first)
        at = lambda name: to.select(F.col("node").alias(f"_{name}"), F.col("to").alias(f"_to_{name}"))
        moved = left.join(at("a"), F.col("a") == F.col("_a")).join(at("b"), F.col("b") == F.col("_b"))
        before, left = left, written(_undirected(moved.select(F.col("_to_a").alias("a"), F.col("_to_b").alias("b"))), "links")
        discard(before)
        if found is None:
            found = to
        else:
            older, found = found, written(_follow(found, to), "roots")
            discard(older, to)
        turn += 1
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.groupBy("to").agg(F.min("node").alias("component")).withColumnRenamed("to", "_root")
    out = written(found.join(roots, F.col("to") == F.col("_root")).select("node", "component"), "components")
    discard(left, found)
    return out


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(pointers: DataFrame, to: DataFrame) -> DataFrame:
    """Each pointer moved on along ``to``; those that lead nowhere further stay."""
    step = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    target: Column = F.coalesce(F.col("_t"), F.col("to"))
    return pointers.join(step, F.col("to") == F.col("_n"), "left").select("node", target.alias("to"))
