import random

import pytest
from pyspark.sql import functions as F

from sievelake.functions.matcher import matches
from sievelake.operators import bitmaps
from sievelake.plans import registry
from sievelake.plans.planner import Predicate
from sievelake.sources.catalog import Catalog, size_pretty
from sievelake.sources.index import CLEANUP, PatternIndex
from sievelake.sources.partitioned import PartitionedIndex

ROWS = [
    ("alpha", "x1"), ("alphabet", None), (None, "x1"), ("", "x2"), ("ALPHA", "y"), ("a_ex", "x"), ("alex", "x"), ("あ", "め"), ("め", "あ"), ("ぁ", "あ"), ("100%", "%"), ("aba", "ab"), ("ab" * 40, "b"),
    ("a" * 300, "a"), ("É", "é"), ("tab\tnew\nline", "z"), ("a\\b", "z"), (None, None), ("xyz" * 3, "xyz"), ("aXbXc", "X"), ("😀a", "x"), ("a😀b", None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "id int, s string, t string").repartition(3)


@pytest.fixture
def index(table, tmp_path):
    return PatternIndex.build(table, f"file://{tmp_path}/one", ["s", "t"])


PATTERNS = ["", "%", "_", "a%", "%a", "%a%", "alpha", "ALPHA", "%l_x%", r"%\_%", r"%\%", "%a%b%a%", "ab%ba", "a%b", "%X%X%", "_X_X_", "%_%_%_%", "あ", "め%", "%xyz%xyz%", "%xyz%xyz%xyz%xyz%", "_%a", "a_%_a", "%\n%", r"%\\%", "a%e_", "%b%_", "😀%", "%😀_", "_a"]


def test_index_agrees_with_matcher(index):
    for operator in ("LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE"):
        for p in PATTERNS if operator != "NOT ILIKE" else PATTERNS[:8]:
            got = sorted(r["id"] for r in index.search([Predicate("s", operator, p)]).collect())
            want = [i for i, (s, _) in enumerate(ROWS) if matches(s, p, "ILIKE" in operator, "NOT" in operator)]
            assert got == want, (operator, p)


def test_null_in_one_key_hides_nothing(index):
    assert [r["id"] for r in index.search([Predicate("s", "LIKE", "alphab%")]).collect()] == [1]
    assert sorted(r["id"] for r in index.search([Predicate("t", "LIKE", "x%"), Predicate("s", "NOT LIKE", "a%")]).collect()) == [3, 18, 20]
    assert index.search([Predicate("s", "LIKE", None)]).count() == 0
    assert index.search([]).count() == len(ROWS)
    with pytest.raises(KeyError):
        index.search([Predicate("u", "LIKE", "a")])


def test_random(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abあ_%") for _ in range(rng.randint(0, 7))) for _ in range(80)]
    index = PatternIndex.build(spark.createDataFrame(list(enumerate(words)), "id int, s string"), f"file://{tmp_path}/r", ["s"])
    for _ in range(25):
        p = "".join(rng.choice(["a", "b", "あ", "%", "_", "\\%", "%"]) for _ in range(rng.randint(1, 6)))
        assert sorted(r["id"] for r in index.search([Predicate("s", "LIKE", p)]).collect()) == [i for i, w in enumerate(words) if matches(w, p)], p


def test_maintenance(spark, table, tmp_path):
    path = f"file://{tmp_path}/m"
    index = PatternIndex.build(table, path, ["s"])
    find = lambda i, p: sorted(r["id"] for r in i.search([Predicate("s", "LIKE", p)]).collect())
    other = PatternIndex(spark, path)
    index.append(spark.createDataFrame([(100, "b" * 2000, None), (101, "alpha two", None)], "id int, s string, t string"))
    assert find(index, "alpha%") == [0, 1, 101] and find(index, "%bbbb") == [100]
    assert find(other, "alpha%") == [0, 1]  # a reader keeps its state
    assert find(PatternIndex(spark, path), "alpha%") == [0, 1, 101]
    assert index.update(F.col("id") == 0, {"s": F.lit("beta")}) == 1
    assert find(index, "alpha%") == [1, 101] and find(index, "beta") == [0]
    assert index.delete(F.col("s").isNull()) == 2  # rows with a null key can be deleted too
    assert index.rows().count() == len(ROWS)
    row = index.stats().first()
    assert (row["active"], row["slots"], row["tombstones"], row["inserts"], row["updates"], row["deletes"], row["max_len"]) == (len(ROWS), len(ROWS) + 3, 3, 2, 1, 2, 2000)
    index.compact()
    index.vacuum()
    assert find(index, "alpha%") == [1, 101] and index.manifest.tombstones == 0
    assert sorted(r["rid"] for r in index.rows().select("rid").collect())[0] >= 1
    index.rebuild()
    assert find(PatternIndex(spark, path), "beta") == [0]
    index.drop()
    with pytest.raises(Exception):
        PatternIndex(spark, path)


def test_many_deletions_clean_up(spark, tmp_path):
    index = PatternIndex.build(spark.range(2500).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).alias("s")), f"file://{tmp_path}/c", ["s"])
    index.delete(F.col("id") < 1200)
    assert index.manifest.tombstones == 0 and index.manifest.dead == []
    assert index.count([Predicate("s", "LIKE", "v%")]).first()["n"] == 1300


def test_cleanup_on_both_sides_of_the_bound(spark, tmp_path):
    for n, cleanup, want in ((CLEANUP - 1, True, (CLEANUP - 1, 0)), (CLEANUP, True, (0, CLEANUP)), (CLEANUP, False, (CLEANUP, 0))):
        index = PatternIndex.build(spark.range(1500).select("id", F.col("id").cast("string").alias("s")), f"file://{tmp_path}/{n}{cleanup}", ["s"])
        assert index.delete(F.col("id") < n, cleanup=cleanup) == n
        row = index.stats().first()
        assert (row["tombstones"], row["free"]) == want and (row["active"], row["deletes"]) == (1500 - n, n)


def test_index_stats_match_sql_beyond_the_bound(spark):
    duckdb = pytest.importorskip("duckdb")
    for sf, beyond in (("sf0.001", False), ("sf0.1", True)):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('/root/testdata/{sf}/part.parquet')")
        want = con.execute(registry.oracle_sql()["index_stats"])
        want = dict(zip([d[0] for d in want.description], want.fetchone()))
        assert (want["deletes"] >= CLEANUP) == beyond
        assert registry.queries()["index_stats"](spark, f"/root/testdata/{sf}").first().asDict() == want


def test_append_of_a_whole_table(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet").select("p_partkey", "p_name")
    more = part.select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), F.concat(F.lit("zz "), F.col("p_name")).alias("p_name"))
    index = PatternIndex.build(part, f"file://{tmp_path}/a", ["p_name"])
    index.append(more)
    n, row = part.count(), index.stats().first()
    assert (row["active"], row["slots"], row["inserts"]) == (2 * n, 2 * n, n)
    both = part.union(more)
    for p in ("zz%", "%ring", "zz%l r_n%"):
        got = sorted(tuple(r) for r in index.search([Predicate("p_name", "LIKE", p)]).collect())
        assert got == sorted(tuple(r) for r in both.collect() if matches(r["p_name"], p)) and got
        assert max(k for k, _ in got) > 1_000_000


def test_empty_table_and_types(spark, tmp_path):
    empty = spark.createDataFrame([], "s string")
    index = PatternIndex.build(empty, f"file://{tmp_path}/e", ["s"])
    assert index.search([Predicate("s", "LIKE", "%")]).count() == 0
    with pytest.raises(Exception):
        PatternIndex.build(spark.range(1), f"file://{tmp_path}/t", ["id"])
    PatternIndex.build(spark.range(20), f"file://{tmp_path}/x", {"k": "cast(id as string)"}).search([Predicate("k", "LIKE", "1%")]).count() == 11


def test_bitmaps(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "rid long")
    a, b = bitmaps.create(ids([1, 2, 32768, 32769, 70000])), bitmaps.create(ids([2, 3, 32769, 99999]))
    back = lambda s: sorted(r[0] for r in bitmaps.to_ids(s).collect())
    assert back(a) == [1, 2, 32768, 32769, 70000]
    assert back(bitmaps.intersection(a, b)) == [2, 32769]
    assert back(bitmaps.union(a, b)) == [1, 2, 3, 32768, 32769, 70000, 99999]
    assert back(bitmaps.difference(a, b)) == [1, 32768, 70000]
    assert back(bitmaps.remove(bitmaps.add(a, ids([5])), ids([1]))) == [2, 5, 32768, 32769, 70000]
    assert bitmaps.count(a).first()["n"] == 5
    assert bitmaps.is_empty(bitmaps.intersection(a, bitmaps.create(ids([9])))) and not bitmaps.is_empty(a)
    assert bitmaps.size_bytes(a).first()["bytes"] == 3 * 4096


def test_catalog(spark, table, tmp_path):
    root = f"file://{tmp_path}"
    empty = Catalog(spark, root)
    assert empty.status().first()["total_indexes"] == 0 and empty.status().first()["total_index_size"] == "0 bytes"
    assert {r["check_name"]: r["status"] for r in empty.check_config().collect()}["indexes"] == "0"
    PatternIndex.build(table, f"{root}/a", ["s"])
    PatternIndex.build(table, f"{root}/b", {"low": "lower(s)", "t": "t"})
    found = {r["index_name"]: r for r in empty.indexes().collect()}
    assert found["a"]["columns"] == "s" and found["b"]["columns"] == "2 columns"
    assert "lower(s) AS low" in {r["index_name"]: r["index_definition"] for r in empty.indexes_detailed().collect()}["b"]
    used = empty.memory_usage().collect()
    assert [r["bytes"] for r in used] == sorted((r["bytes"] for r in used), reverse=True) and used[0]["bytes"] > 0
    assert {r["check_name"]: r["status"] for r in empty.check_config().collect()}["indexes"] == "2"
    assert {r["index_name"] for r in spark.table(empty.register_views()[0]).collect()} == {"a", "b"}


def test_unfinished_versions_are_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    index = PatternIndex.build(spark.createDataFrame([("a",), ("b",)], "s string"), path, ["s"])
    (tmp_path / "u/manifest/v=2").mkdir()  # a writer that was lost before its text was there
    (tmp_path / "u/manifest/v=3").mkdir()
    (tmp_path / "u/manifest/v=3/part-0.txt").write_text('{"name": "u", "ke')
    again = PatternIndex(spark, path)
    assert again.version == 1 and again.count([Predicate("s", "LIKE", "_")]).first()["n"] == 2
    again.append(spark.createDataFrame([("c",)], "s string"))
    assert again.version == 4 and PatternIndex(spark, path).count([Predicate("s", "LIKE", "_")]).first()["n"] == 3
    del index


def test_partition_values_of_any_kind(spark, tmp_path):
    values = ["a/b", "x=y", "null", None, "", "é %", "007"]
    df = spark.createDataFrame([(f"{k}{j}", v) for k, v in enumerate(values) for j in range(3)], "s string, part string")
    index = PartitionedIndex.build(df, f"file://{tmp_path}/p", ["s"], "part")
    for k, v in enumerate(values):
        if v != "":  # an empty text is no name for a folder: Spark stores it with the nulls
            got = sorted(r["s"] for r in index.search([Predicate("s", "LIKE", "%")], [v]).collect())
            assert got == sorted(f"{n}{j}" for n, u in enumerate(values) if u == v or (v is None and u == "") for j in range(3)), v
    assert index.search([Predicate("s", "LIKE", "_1")]).count() == len(values) and index.search([], ["other"]).count() == 0
    assert index.search([Predicate("s", "LIKE", "%")], ["a/b"]).columns == df.columns


def test_size_pretty():
    assert [size_pretty(n) for n in (0, 1023, 1536, 5 << 20, 3 << 30)] == ["0 bytes", "1023 bytes", "1.50 KB (1536 bytes)", "5.00 MB (5242880 bytes)", "3.00 GB (3221225472 bytes)"]
