"""Tasks of the stored index hold a bounded number of postings: more of them, not larger ones, on larger tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievelake.functions.matcher import matches
from sievelake.operators import bitmaps
from sievelake.plans.planner import Predicate
from sievelake.sources import index as stored
from sievelake.sources.index import PatternIndex
from sievelake.sources.partitioned import PartitionedIndex

WORDS = ["small ring", "aaaa", "", "Ring", None, "hot é bolt", "spring", "a a a"]
PATTERNS = ["", "%", "%ring", "s%", "%a%a%", "%a%a%a%a%", "_____%", "%é%", "%zz%"]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(stored, "TASK_ROWS", 100, raising=False)


def table(spark, first, n):
    return spark.range(first, first + n, numPartitions=2).select("id", F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % len(WORDS) + 1).cast("int")).alias("s"))


def agrees(index, want):
    for p in PATTERNS:
        for operator in ("LIKE", "NOT ILIKE"):
            got = sorted(r["id"] for r in index.search([Predicate("s", operator, p)]).collect())
            assert got == sorted(i for i, s in want.items() if matches(s, p, "ILIKE" in operator, "NOT" in operator)), (operator, p)


def largest(spark, path):
    return max(r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_tasks_are_bounded_and_right(spark, few, tmp_path):
    index = PatternIndex.build(table(spark, 0, 400), f"file://{tmp_path}/i", ["s"])
    want = {i: WORDS[i % len(WORDS)] for i in range(400)}
    n = index.chars().count()
    assert n > 1500 and largest(spark, f"{index.path}/chars") <= 300  # in two files a case before: 700 and more in each
    assert index.parts == len(index.ids([Predicate("s", "LIKE", "%ring")]).rdd.glom().collect()) > 5
    agrees(index, want)
    index.append(table(spark, 400, 200))
    want |= {i: WORDS[i % len(WORDS)] for i in range(400, 600)}
    assert index.delete(F.col("id") % 7 == 0, cleanup=False) == 86  # more than are broadcast
    want = {i: s for i, s in want.items() if i % 7}
    agrees(PatternIndex(spark, index.path), want)
    kept = {r["rid"]: r["id"] for r in index.rows().collect()}
    index.compact()
    index.vacuum()
    assert {r["rid"]: r["id"] for r in index.rows().collect()} == kept and largest(spark, f"{index.path}/chars") <= 300
    assert index.update(F.col("id") % 5 == 0, {"s": F.lit("spring")}) == sum(i % 5 == 0 for i in want)
    agrees(index, {i: s if i % 5 else "spring" for i, s in want.items()})
    both = index.ids([Predicate("s", "LIKE", "s%")]).union(index.ids([Predicate("s", "LIKE", "%ring")]))
    assert sorted(r["id"] for r in index.fetch(both).collect()) == [i for i, s in want.items() if i % 5 == 0 or s in ("small ring", "spring")]


def test_parts_of_partition_values_and_older_manifests(spark, few, tmp_path):
    rows = table(spark, 0, 240).withColumn("part", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")))
    found = PartitionedIndex.build(rows, f"file://{tmp_path}/p", ["s"], "part")
    for value in ("1", None):
        got = sorted(r["id"] for r in found.search([Predicate("s", "LIKE", "%ring")], [value]).collect())
        assert got == [i for i in range(240) if WORDS[i % 8] in ("small ring", "spring") and i % 3 == (1 if value else 0)]
    state = next((tmp_path / "p/manifest/v=1").glob("part-*.txt"))
    kept = {k: v for k, v in json.loads(state.read_text()).items() if k != "load"}
    (tmp_path / "p/manifest/v=1" / f".{state.name}.crc").unlink()
    state.write_text(json.dumps(kept))
    older = PatternIndex(spark, found.index.path)
    assert older.manifest.load is None and older.parts == found.index.parts > 1
    agrees(older, {i: WORDS[i % 8] for i in range(240)})


def test_difference_and_dealt_bitmaps(spark):
    rng = random.Random(5)
    a, b = ({rng.randint(1, 140_000) for _ in range(3000)} | set(top) for top in ((32_768, 65_536, 131_073), (65_536, 65_537)))
    a, b = a | set(range(33_000, 34_000)), b | set(range(33_500, 33_900))
    make = lambda xs: bitmaps.create(spark.createDataFrame([(x,) for x in xs], "rid long"), parts=3)
    back = lambda s: sorted(r[0] for r in bitmaps.to_ids(s).collect())
    assert make(a).rdd.getNumPartitions() == 3
    left = bitmaps.difference(make(a), make(b))
    assert back(left) == sorted(a - b)
    assert "Generate" not in left._jdf.queryExecution().optimizedPlan().toString()  # no id is spread
    assert back(bitmaps.difference(make(a), make({1}))) == sorted(a - {1}) and bitmaps.is_empty(bitmaps.difference(make(a), make(a)))
