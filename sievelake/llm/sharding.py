"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get dense global row numbers in an order that only their content decides; the permutation sends number ``i``
to place ``p``; shard and slot are ``p % shards`` and ``p div shards``. Anybody who knows the row count and the seed
can compute either from the row number alone, and the counts of two shards differ by one at most.

Everything is DataFrame expressions. Equal rows are counted before any shuffle, so a hot row costs one counter; numbers
come from fixed hash buckets (a window inside each bucket, a prefix sum over the bucket counts), never from one sort task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that global row numbers are built from: a fixed number, so the table of their counts is bounded.
BUCKETS = 4096
ROUNDS = 6
#: Steps of the cycle walk. The domain a*b is under n + a with a = ceil(sqrt n): up to n = 3969 the walk ends within
#: a + 1 <= 64 steps by construction, above that a value outside is rarer than 1 in 63 at each step.
WALK = 64
#: Copies of one row that are numbered by one task.
RUN = 4096


def unfold(df: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, with its turn ``_k`` from 1: runs of RUN copies are dealt over the tasks before they are spelled out."""
    runs = df.withColumn("_run", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {RUN})"))).repartition(F.xxhash64(*df.columns), "_run")
    return runs.withColumn("_k", F.explode(F.expr(f"sequence(_run * {RUN} + 1, least({count}, (_run + 1) * {RUN}))"))).drop("_run")


def row_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per row of ``df``: ``cols``, ``row_number`` (dense, from 0) and ``n_rows``.

    The order is by a hash of ``cols``, then by ``cols`` (nulls first); rows equal in all ``cols`` can't be told apart
    and share a range of numbers. The same rows get the same numbers however the input is split.
    """
    bucket = F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", bucket)
    in_bucket = Window.partitionBy("_b").orderBy(F.xxhash64(*cols), *cols)
    ranged = counted.withColumn("_end", F.sum("_c").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    totals = counted.groupBy("_b").agg(F.sum("_c").alias("_t"))
    # at most BUCKETS rows, folded into one array so that the prefix sum needs no sort of the data
    sums = totals.agg(F.map_from_entries(F.collect_list(F.struct("_b", "_t"))).alias("_m")).select(
        F.coalesce(F.aggregate(F.map_values("_m"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_rows"),
        F.posexplode(
            F.expr(
                f"aggregate(sequence(0, {BUCKETS - 1}), array(0L), (a, i) -> concat(a, array(element_at(a, -1) + coalesce(_m[i], 0L))))"
            )
        ).alias("_b", "_first"),
    )
    return (
        unfold(ranged.join(F.broadcast(sums), "_b"), "_c")
        .select(*cols, (F.col("_first") + F.col("_end") - F.col("_k")).alias("row_number"), "n_rows")
    )


def feistel(number: Column, n: Column, seed: int = 7) -> Column:
    """Where the permutation of [0, n) sends ``number``: alternating rounds on (left, right) in a x b >= n, walked until inside."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n.cast("double") / a), F.lit(1)).cast("long")

    def once(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), a), a)
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), b), b)
            odd = i % 2 == 1
            return F.struct(F.when(odd, left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(right).alias("r"))

        start = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])

    first = once(number)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit(f"no place after {WALK} steps of the cycle walk")).cast("long"))


def shard(df: DataFrame, cols: list[str], shards: int = 16, seed: int = 7) -> DataFrame:
    """``cols``, ``row_number``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within its shard), one row per row of ``df``.

    Nulls are values like others, equal rows get different slots, an empty table gives an empty result. Columns of
    ``df`` outside ``cols`` are neither read nor returned; ``cols`` may have any names, also those used on the way.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    own = [f"c{i}" for i in range(len(cols))]
    named = [F.col(o).alias(c) for o, c in zip(own, cols)]
    placed = row_numbers(df.select(*[F.col(c).alias(o) for o, c in zip(own, cols)]), own).withColumn("_p", feistel(F.col("row_number"), F.col("n_rows"), seed))
    return placed.select(*named, "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_p div {int(shards)}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The sharding digest of ``documents``: law ``rows`` (counts at most one apart).

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 is that of the text (null: that of the empty one).
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(keyed, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
