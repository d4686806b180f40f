"""What several operators share: reading tables, the shared folder, fixed-rule hashes and written tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The token of the word contracts: a run of bytes that are not ASCII white space (space, \t \n \v \f \r).
TOKEN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}
_RUNS: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, one machine (a local master) gets a temporary folder; a cluster an error, since its
    executors would each write to a disk of their own. The session's settings are left as they are.
    """
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sievelake-"))


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is removed when the driver ends, or earlier by ``cleanup``."""
    path = f"{shared_dir(spark)}/sievelake-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        p, fs = _fs(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _RUNS.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing reads any more; other frames are left alone."""
    for t in tables:
        if t is not None and (path := _PATHS.pop(t, None)):
            p, fs = _fs(t.sparkSession, path)
            fs.delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Remove all tables that this application's operators wrote; results that are still to be read need them."""
    path = run_dir(spark)
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    _RUNS.discard(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def default_parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: Rows of an Arrow batch of texts, where the session sets none: batches of ten thousand texts would weigh tens of MB on either side.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Give the session ARROW_ROWS rows a batch, unless it has a setting of its own.

    Spark reads this setting when a result is computed, long after an operator has returned it, so it can't be put back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_ROWS))


#: Text bytes of the pieces that Arrow batches are worked off in: what a Python worker makes of a piece stays small.
LIGHT = 4 << 20


def light(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about LIGHT bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LIGHT, "right")))
            yield batch.slice(at, to - at)
            at = to
