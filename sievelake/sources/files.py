"""Reading and writing tables, and the key columns that patterns are matched on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a cluster an error: its executors share no local disk.
    """
    root, master = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='sievelake-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table from any of FORMATS. Give a schema for json and csv: none is inferred from a pass over the data unless asked for."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def text_key(df: DataFrame, key: Column | str) -> Column:
    """A key as text: string columns and expressions as they are, char(n) without its padding rules; other types must be cast by the caller."""
    column = F.col(key) if isinstance(key, str) else key
    kind = df.select(column.alias("k")).schema["k"].dataType
    if not isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        raise TypeError(f"patterns match text; cast the {kind.simpleString()} key to string first")
    return column.cast("string")


def with_lowered(df: DataFrame, *columns: str, suffix: str = "_lower") -> DataFrame:
    """``df`` with stored lower-case twins: ILIKE on a stored twin reaches the scan as a plain string filter."""
    return df.withColumns({f"{c}{suffix}": F.lower(c) for c in columns})
