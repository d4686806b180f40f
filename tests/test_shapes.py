import pytest
from pyspark.sql import functions as F

from sievelake.operators import search
from sievelake.plans.planner import Predicate
from sievelake.sources import files
from sievelake.streaming import filters


def test_shapes(spark):
    df = spark.createDataFrame([(i, f"name{i}", "even" if i % 2 == 0 else "odd") for i in range(30)], "id int, s string, g string")
    ps = [Predicate("s", "LIKE", "name1%")]
    assert search.count(df, ps).first()["n"] == 11
    assert search.exists(df, ps).first()["found"] is True
    assert search.exists(df, [Predicate("s", "LIKE", "x%")]).first()["found"] is False
    assert {r["g"]: r["n"] for r in search.group_count(df, ["g"], ps).collect()} == {"even": 5, "odd": 6}
    assert [r["id"] for r in search.search(df, ps, F.col("id") > 10, columns=["id"], order_by=[F.desc("id")], limit=3, offset=2).collect()] == [17, 16, 15]
    assert search.count_filters(df, {"a": ps[0], "b": F.col("id") < 3}).first().asDict() == {"a": 11, "b": 3}
    top = search.search(df, ps, order_by=[F.desc("id")], limit=3)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_pattern_join(spark):
    df = spark.createDataFrame([("apple",), ("banana",), (None,)], "s string")
    patterns = spark.createDataFrame([("%an%",), ("a%",), ("%",), (None,)], "pattern string")
    assert sorted((r["s"], r["pattern"]) for r in search.pattern_join(df, "s", patterns).collect()) == [("apple", "%"), ("apple", "a%"), ("banana", "%"), ("banana", "%an%")]
    with pytest.raises(ValueError):
        search.pattern_join(df, "s", patterns, small=2)


def test_pattern_join_in_blocks(spark):
    df = spark.createDataFrame([(f"v{i % 40}",) for i in range(60)] + [(None,)], "s string").repartition(3)
    patterns = spark.createDataFrame([(p,) for p in [f"v{i}%" for i in range(20)] + ["%", "%", "%3", None]], "pattern string")
    pairs = lambda d: sorted((r["s"], r["pattern"]) for r in d.collect())
    joined = search.pattern_join(df, "s", patterns, block=5)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert pairs(joined) == pairs(search.pattern_join(df, "s", patterns)) != []


def test_pattern_join_with_many_patterns(spark):
    df = spark.createDataFrame([("p7",), ("p100400",), ("q",)], "s string")
    many = spark.range(100_500).select(F.concat(F.lit("p"), "id").alias("pattern"))
    assert sorted((r["s"], r["pattern"]) for r in search.pattern_join(df, "s", many).collect()) == [("p100400", "p100400"), ("p7", "p7")]


def test_stream_meets_many_patterns(spark, tmp_path):
    spark.createDataFrame([("p7",), ("p100400",), ("q",)], "s string").write.parquet(f"{tmp_path}/in")
    many = spark.range(100_500).select(F.concat(F.lit("p"), "id").alias("pattern"))
    joined = filters.matches_of(spark.readStream.schema("s string").parquet(f"{tmp_path}/in"), many, "s")
    joined.writeStream.format("memory").queryName("many").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["pattern"] for r in spark.table("many").collect()) == ["p100400", "p7"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    files.write(df, f"{tmp_path}/{fmt}", fmt)
    assert sorted(files.read(spark, f"{tmp_path}/{fmt}", fmt, schema="id int, s string").collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        files.read(spark, "x", "xls")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "click" if i % 3 else "view") for i in range(20)], "id int, at string, kind string").select("id", F.to_timestamp("at").alias("ts"), "kind").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(f"{tmp_path}/in")
    ps = [Predicate("kind", "ILIKE", "CL_CK")]
    patterns = spark.createDataFrame([("v%",), ("%i%",)], "pattern string")
    for name, df, mode in (("plain", filters.matching(stream, ps), "append"), ("windows", filters.windowed_counts(stream, ps, "ts", "10 minutes", "5 minutes", "kind"), "complete"), ("joined", filters.matches_of(stream, patterns, "kind"), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("plain").count() == 13
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [6, 7]
    assert spark.table("joined").count() == 27
