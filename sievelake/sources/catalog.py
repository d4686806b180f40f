"""What there is and how it is set up: indexes under a root folder, operators, status, sizes, version and configuration."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

import pyspark
from pyspark.sql import DataFrame, SparkSession

from sievelake.plans.planner import OPERATORS

from .index import PatternIndex, _list, _size

VERSION = "0.1.0"
#: Releases of this library.
HISTORY = (("0.1.0", "Pattern predicates, planner, stored postings index, catalog, streaming filters and training-data operators"),)
#: Segments of one index beyond which compaction is advised.
MANY_SEGMENTS = 16
#: Operator signs by strategy number.
SIGNS = {1: "~~", 2: "!~~", 3: "~~*", 4: "!~~*"}


def version() -> str:
    return VERSION


def spark_version() -> str:
    return pyspark.__version__


def has_bitmap_functions(spark: SparkSession) -> bool:
    return all(spark.catalog.functionExists(f) for f in ("bitmap_construct_agg", "bitmap_and_agg", "bitmap_or_agg", "bitmap_count"))


def build_info(spark: SparkSession) -> DataFrame:
    """feature, enabled, description: two rows."""
    bitmaps = has_bitmap_functions(spark)
    return spark.createDataFrame(
        [
            ("Bitmap functions", bitmaps, "Set algebra on row ids runs on built-in bitmaps" if bitmaps else "Set algebra falls back to joins"),
            ("Apache Spark", True, f"Running on Spark {spark_version()}"),
        ],
        "feature string, enabled boolean, description string",
    )


def build_info_json(spark: SparkSession) -> str:
    return json.dumps({"version": VERSION, "bitmaps_enabled": has_bitmap_functions(spark), "spark_version": spark_version()})


def operators(spark: SparkSession) -> DataFrame:
    """opfamily, strategy, operator, left_type, right_type, description: the four predicates."""
    rows = [("text_ops", k, SIGNS[k], "text", "text", name) for k, name in OPERATORS.items()]
    return spark.createDataFrame(rows, "opfamily string, strategy int, operator string, left_type string, right_type string, description string")


def version_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HISTORY), "version string, description string")


def size_pretty(n: int) -> str:
    """Bytes for people: '512 bytes', '1.50 KB (1536 bytes)', then MB and GB."""
    if n < 1024:
        return f"{n} bytes"
    for unit, scale in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        if n < scale << 10 or unit == "GB":
            return f"{(Decimal(n) / scale).quantize(Decimal('0.01'), ROUND_HALF_UP)} {unit} ({n} bytes)"
    raise AssertionError


class Catalog:
    """The indexes in the folders of ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def open(self, name: str) -> PatternIndex:
        return PatternIndex(self.spark, f"{self.root}/{name}")

    def _all(self) -> list[PatternIndex]:
        names = sorted(p.rsplit("/", 1)[-1] for p in _list(self.spark, self.root))
        return [self.open(n) for n in names if _list(self.spark, f"{self.root}/{n}/manifest")]

    def indexes(self) -> DataFrame:
        """schema_name, index_name, num_columns, columns, index_size, path. A single key that is an expression shows as (expression)."""
        rows = []
        for i in self._all():
            keys = i.manifest.keys
            (first, e) = next(iter(keys.items()))
            shown = f"{len(keys)} columns" if len(keys) > 1 else first if e.strip("`") == first else "(expression)"
            rows.append((self.root.rsplit("/", 1)[-1], i.manifest.name, len(keys), shown, size_pretty(i.size_bytes()), i.path))
        return self.spark.createDataFrame(rows, "schema_name string, index_name string, num_columns int, columns string, index_size string, path string")

    def indexes_detailed(self) -> DataFrame:
        """The same with the full definition of the keys."""
        rows = [
            (self.root.rsplit("/", 1)[-1], i.manifest.name, len(i.manifest.keys), "PATTERN INDEX " + i.manifest.name + " (" + ", ".join(f"{e} AS {k}" for k, e in i.manifest.keys.items()) + ")", size_pretty(i.size_bytes()), i.path)
            for i in self._all()
        ]
        return self.spark.createDataFrame(rows, "schema_name string, index_name string, num_columns int, index_definition string, index_size string, path string")

    def memory_usage(self) -> DataFrame:
        """schema_name, index_name, bytes (postings), human_readable, disk_size (all files), largest first."""
        rows = sorted(((self.root.rsplit("/", 1)[-1], i.manifest.name, n := i.size_bytes(), size_pretty(n), size_pretty(_size(self.spark, i.path))) for i in self._all()), key=lambda r: -r[2])
        return self.spark.createDataFrame(rows, "schema_name string, index_name string, bytes long, human_readable string, disk_size string")

    def status(self) -> DataFrame:
        """version, bitmaps_enabled, bitmap_implementation, total_indexes, total_index_size (0 bytes without any)."""
        found, bitmaps = self._all(), has_bitmap_functions(self.spark)
        row = (VERSION, bitmaps, "bitmap aggregates of Spark" if bitmaps else "joins of id tables", len(found), size_pretty(sum(i.size_bytes() for i in found)))
        return self.spark.createDataFrame([row], "version string, bitmaps_enabled boolean, bitmap_implementation string, total_indexes long, total_index_size string")

    def check_config(self) -> DataFrame:
        """check_name, status, recommendation (empty where nothing need be done): what can slow a search down or break a run on a cluster."""
        found = self._all()
        shared = self.spark.conf.get("spark.checkpoint.dir", "")
        segments = max((len(i.manifest.segments) for i in found), default=0)
        dead = sum(i.manifest.tombstones for i in found)
        rows = [
            ("shared folder", "set" if shared else "unset", "" if shared else "name a folder that all executors see in spark.checkpoint.dir"),
            ("bitmap aggregates", "present" if has_bitmap_functions(self.spark) else "absent", "" if has_bitmap_functions(self.spark) else "id sets need a newer Spark"),
            ("indexes", str(len(found)), "" if found else "build one where the same key is searched often"),
            ("segments of an index, at most", str(segments), "compact it: every segment is a set of files to open" if segments > MANY_SEGMENTS else ""),
            ("deleted rows still stored", str(dead), "compact: searches join them away each time" if dead else ""),
        ]
        return self.spark.createDataFrame(rows, "check_name string, status string, recommendation string")

    def register_views(self, prefix: str = "sieve_") -> list[str]:
        """Temporary views of the catalog as it is now, for SQL; their names."""
        views = {"indexes": self.indexes, "indexes_detailed": self.indexes_detailed, "memory_usage": self.memory_usage, "status": self.status, "check_config": self.check_config}
        for name, make in views.items():
            make().createOrReplaceTempView(prefix + name)
        return [prefix + name for name in views]
