"""Query shapes over pattern predicates: rows, count, existence, grouping, top-k with offset, joins with a pattern table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.predicate import like
from sievelake.plans.planner import Predicate, where


def search(
    df: DataFrame, predicates: Iterable[Predicate], *companions: Column, columns: list[str] | None = None, order_by: list[Column] | None = None, limit: int | None = None, offset: int | None = None
) -> DataFrame:
    """Matching rows; ordered and limited as asked (a top-k, not a sort of everything)."""
    out = where(df, predicates, *companions)
    if columns is not None:
        out = out.select(*columns)
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def count(df: DataFrame, predicates: Iterable[Predicate], *companions: Column, name: str = "n") -> DataFrame:
    return where(df, predicates, *companions).agg(F.count(F.lit(1)).alias(name))


def exists(df: DataFrame, predicates: Iterable[Predicate], *companions: Column, name: str = "found") -> DataFrame:
    """One row; the scan stops at the first match of a task."""
    return where(df, predicates, *companions).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))


def group_count(df: DataFrame, by: list[str], predicates: Iterable[Predicate], *companions: Column, name: str = "n") -> DataFrame:
    return where(df, predicates, *companions).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_filters(df: DataFrame, named: dict[str, Predicate | Column]) -> DataFrame:
    """COUNT(*) FILTER (WHERE ...) for several conditions in one pass."""
    return df.agg(*[F.count_if(p.condition() if isinstance(p, Predicate) else p).alias(name) for name, p in named.items()])


def pattern_join(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern", small: int | None = None, block: int = 100_000, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``df`` with every row of a table of patterns that they match.

    LIKE has no key to join on, so each row meets each pattern: one pass over ``df`` with the patterns broadcast. More than ``block``
    patterns, or more than ``block_bytes`` of them, are cut into blocks of about that many, and each part of ``df`` meets each block in a task of its own; nothing is
    broadcast then. With ``small``, larger tables of patterns are refused.
    """
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(pattern)).alias("b")).first()
    n, blocks = size["n"], max(-(-size["n"] // block), -(-(size["b"] or 0) // block_bytes))
    if small is not None and n > small:
        raise ValueError(f"{n} patterns; more than {small}")
    if blocks <= 1:
        met = F.broadcast(patterns)
    else:
        met = patterns.repartition(blocks).hint("shuffle_replicate_nl")
    return df.join(met, like(df[column], patterns[pattern]))
