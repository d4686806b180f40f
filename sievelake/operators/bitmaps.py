"""Sets of row ids as bitmaps: one (bucket, bits) row for each 32,768 ids, with Spark's bitmap functions.

Ids start at 1 (0 and 1 would share a place). A set operation is one aggregation over buckets, whatever the number of sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids in a bucket, bytes of its bitmap.
BUCKET, BYTES = 32_768, 4_096


def create(ids: DataFrame, rid: str = "rid", parts: int | None = None) -> DataFrame:
    """(bucket, bits) of a table of ids; repeated ids and nulls make no difference.

    ``parts``: ids are dealt by bucket into so many partitions; without it each partition of ids makes a part of each of its buckets.
    """
    kept = ids.where(F.col(rid).isNotNull()).select(F.bitmap_bucket_number(rid).alias("bucket"), F.bitmap_bit_position(rid).alias("at"))
    return (kept if parts is None else kept.repartition(parts, "bucket")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _all(sets: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("bucket", "bits") for s in sets])


def intersection(*sets: DataFrame) -> DataFrame:
    """AND: buckets that every set has, bits ANDed; buckets that come out empty are dropped."""
    met = _all(sets).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.where((F.col("n") == len(sets)) & (F.bitmap_count("bits") > 0)).drop("n")


def union(*sets: DataFrame) -> DataFrame:
    return _all(sets).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count(bits: DataFrame, name: str = "n") -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))


def is_empty(bits: DataFrame) -> bool:
    return bits.where(F.bitmap_count("bits") > 0).limit(1).isEmpty()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND NOT, by bucket: Spark has no bitmap complement, so both bitmaps are read as words of 8 hex digits."""
    met = a.select("bucket", F.hex("bits").alias("a")).join(b.select("bucket", F.hex("bits").alias("b")), "bucket", "left")
    word = lambda of: f"cast(conv(substring({of}, 8 * i + 1, 8), 16, 10) AS bigint)"
    words = f"transform(sequence(0, {BYTES // 4 - 1}), i -> lpad(hex({word('a')} & ~{word('b')}), 8, '0'))"
    bits = F.when(F.col("b").isNull(), F.unhex("a")).otherwise(F.unhex(F.array_join(F.expr(words), "")))
    return met.select("bucket", bits.alias("bits")).where(F.bitmap_count("bits") > 0)


def to_ids(bits: DataFrame) -> DataFrame:
    """The ids of a set: set bits of each byte, through a table of the bytes' values; no Python."""
    byte = F.expr(f"explode(sequence(0, {BYTES - 1}))")
    spread = bits.select("bucket", "bits", byte.alias("i")).select("bucket", "i", F.expr("conv(hex(substring(bits, i + 1, 1)), 16, 10)").cast("int").alias("v")).where("v > 0")
    bit = spread.withColumn("k", F.expr("explode(filter(sequence(0, 7), k -> getbit(v, k) = 1))"))
    return bit.select(((F.col("bucket") - 1) * BUCKET + F.col("i") * 8 + F.col("k") + 1).cast("long").alias("rid"))


def add(bits: DataFrame, ids: DataFrame, rid: str = "rid") -> DataFrame:
    return union(bits, create(ids, rid))


def remove(bits: DataFrame, ids: DataFrame, rid: str = "rid") -> DataFrame:
    return difference(bits, create(ids, rid))


def size_bytes(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).cast("long").alias("bytes"))
