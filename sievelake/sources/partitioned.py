"""An index in parts, one for each value of a partition column, so that queries on few partitions read few folders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.plans.planner import Predicate

from .index import _BY, PatternIndex


class PartitionedIndex:
    """A pattern index whose rows and postings stand in a folder for each value of its partition column.

    It is built in one pass, whatever the number of values. Values may hold any characters; null is a value of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.index = PatternIndex(spark, path)
        if self.index.manifest.by is None:
            raise ValueError(f"the index at {path} has no partition column")

    @classmethod
    def build(cls, df: DataFrame, path: str, keys: dict[str, str] | list[str], by: str) -> PartitionedIndex:
        PatternIndex.build(df, path, keys, by=by)
        return cls(df.sparkSession, path)

    def values(self) -> DataFrame:
        """The partition values, as text."""
        return self.index.lengths().select(F.col(_BY).alias("value")).distinct()

    def search(self, predicates: Iterable[Predicate], values: Iterable | None = None) -> DataFrame:
        """Matching rows of the partitions ``values`` (all, if None); other partitions are not read. Unknown values have no rows."""
        return self.index.search(list(predicates), None if values is None else [v if v is None else str(v) for v in values])
