"""Pattern predicates on streams: they keep no state, so any streaming DataFrame can be filtered by them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.plans.planner import Predicate, where


def matching(stream: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """Rows of a stream that pass all predicates."""
    return where(stream, predicates)


def windowed_counts(stream: DataFrame, predicates: Iterable[Predicate], ts: str, window: str, late: str, *by: str, name: str = "n") -> DataFrame:
    """Matches in tumbling windows of event time; rows later than ``late`` behind the watermark are dropped."""
    return matching(stream, predicates).withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias(name))


def matches_of(stream: DataFrame, patterns: DataFrame, column: str, pattern: str = "pattern") -> DataFrame:
    """Each row of a stream with the rows of a small static table of patterns that it matches."""
    from sievelake.operators.search import pattern_join

    return pattern_join(stream, column, patterns, pattern)
