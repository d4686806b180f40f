"""Registered queries over the stored index: no task writes more postings because the table is larger, and rows are the SQL's."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sievelake.plans import registry
from sievelake.sources import index as stored

NAMES = [
    "index_stats",
    "maint_rebuild",
    "maint_cleanup",
    "maint_compact",
    "maint_delete",
    "bitmap_or_count",
    "bitmap_and_count",
    "index_partial",
]
LIMIT = 2000


@pytest.mark.parametrize("name", NAMES)
def test_postings_are_dealt_by_their_number(spark, monkeypatch, name):
    sf_dir, files = "/root/testdata/sf0.01", []
    store = stored.PatternIndex._store

    def spied(self, what, segment, frame):
        store(self, what, segment, frame)
        if what == "chars":  # read at once: a vacuum may come
            written = spark.read.parquet(f"{self.path}/chars/seg={segment}")
            files.extend(r["n"] for r in written.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())

    monkeypatch.setattr(stored, "TASK_ROWS", LIMIT, raising=False)
    monkeypatch.setattr(stored.PatternIndex, "_store", spied)
    monkeypatch.setattr(registry, "_BUILT", {})
    found = registry.queries()[name](spark, sf_dir)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf_dir}/part.parquet'")
        want = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.fetchall())
    assert sum(files) > 8 * LIMIT and max(files) <= LIMIT
