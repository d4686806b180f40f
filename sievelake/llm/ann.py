"""Approximate nearest neighbours: an inverted multi-index over two vector halves.

Each half is quantised by K centroids learnt on a bounded sample; a vector's cell is its pair of centroids, K x K cells in all.
A query ranks the centroids of either half by inner product and walks the pairs in order of the summed values with a
heap, until the cells passed hold a share (``probe_of``) of all rows. The rows of those cells are reranked by the exact inner product.

Rows are dealt into equal parts of PART at most by cell (a hot cell over several), queries into blocks; every (block, part) is one
piece of work that multiplies, cell by cell, only the queries that visit the cell, and sends each query's best on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parallelism, written
from .vectors import matrix, usable

#: Centroids for each half; vectors that they are learnt from at most; rows of a part; queries of a block.
CENTROIDS, SAMPLE, PART, BLOCK = 16, 20_000, 32_768, 16_384
#: (largest width, share of the rows that a query visits at least); wider vectors take WIDE. On directions without any structure, the hardest
#: case, recall falls with the width: 0.958 at 64, 0.938 at 128 and 0.933 at 256 with these shares.
PROBES, WIDE = ((64, 0.7), (128, 0.75), (256, 0.8)), 0.9
#: Rows below which a part isn't cut further to keep more tasks busy; scores that a task holds at a time.
LEAST, SCORES = 4096, 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Centroids of rows; fewer than k where there are fewer different rows."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
    """Cells in order of summed value (largest first) until they hold ``want`` rows: the multi-sequence walk with a heap."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap, seen, out, have = [(-one[a[0]] - two[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(two) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            have += sizes[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-one[a[x]] - two[b[y]], x, y))
    return out


def probe_of(width: int) -> float:
    return next((share for most, share in PROBES if width <= most), WIDE)


def deal(total: int, part: int, tasks: int) -> tuple[int, int]:
    """(parts, rows in each): parts of ``part`` rows at most, and down to LEAST rows where that keeps more of ``tasks`` busy."""
    parts = max(1, -(-total // part), min(tasks, -(-total // LEAST)))
    size = max(1, -(-total // parts))
    return max(1, -(-total // size)), size


def search(vectors: DataFrame, is_query, neighbours: int = 20, probe: float | None = None, centroids: int = CENTROIDS, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``vectors`` (vec_id, embedding) where ``is_query`` holds.

    score is the inner product in double precision of the vectors as they are; ties go to the smaller vec_id; a query doesn't find rows
    of its own id. Vectors that are null, zero or hold null or non-finite components and ids that are null take no part. Each length of
    vectors has an index of its own, and queries find vectors of their length (an id with two lengths has neighbours of either). With
    no more candidates than ``neighbours``, all are returned.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("_query")).where(usable("embedding") & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("w")).agg(F.count_if("_query").alias("asks")).where("asks > 0").orderBy("w").collect()
    found = [_search(rows.where(F.size("embedding") == r["w"]), r["w"], neighbours, probe_of(r["w"]) if probe is None else probe, centroids, part, block) for r in widths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, width: int, neighbours: int, probe: float, centroids: int, part: int, block: int) -> DataFrame:
    """``search`` among usable rows (vec_id, embedding, _query) of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    x = matrix(sample.column("embedding"), width)
    half = (width + 1) // 2
    one = kmeans(x[:, :half], centroids)
    two = kmeans(x[:, half:], centroids) if width > 1 else np.zeros((1, 0))
    cells = len(one) * len(two)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), width)
            cell = nearest(x[:, :half], one) * len(two) + nearest(x[:, half:], two) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    table = written(rows.mapInArrow(index, f"vec_id long, embedding {kind}, _query boolean, cell int"), "vector-index")
    sizes = np.zeros(cells, np.int64)
    for r in table.groupBy("cell").count().collect():  # at most centroids squared rows
        sizes[r["cell"]] = r["count"]
    want = max(probe * sizes.sum(), neighbours + 1)
    # a cell's rows start at its offset in a virtual order of all rows; parts are runs of it, a large cell takes several
    first = np.cumsum(sizes) - sizes
    parts, size = deal(int(sizes.sum()), part, default_parallelism(rows))
    blocks = int(max(1, -(-table.where("_query").count() // block)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("embedding"), width)
            s1, s2 = q[:, :half] @ one.T, q[:, half:] @ two.T
            own = [walk(a, b, sizes, want) for a, b in zip(s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(own, pa.list_(pa.int32()))], ["vec_id", "embedding", "visits"])

    queries = table.where("_query").select("vec_id", "embedding").mapInArrow(visits, f"vec_id long, embedding {kind}, visits array<int>")
    offset = F.element_at(F.array(*[F.lit(int(v)) for v in first]), F.col("cell") + 1) + F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(int(max(1, v))) for v in sizes]), F.col("cell") + 1))
    none = F.lit(None).cast("array<int>")
    left = table.select(F.col("vec_id"), "embedding", "cell", none.alias("visits"), F.expr(f"explode(sequence(0, {blocks - 1}))").alias("block"), (offset / size).cast("int").alias("part"))
    right = queries.select("vec_id", "embedding", F.lit(None).cast("int").alias("cell"), "visits", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.expr(f"explode(sequence(0, {parts - 1}))").alias("part"))

    def rerank(group: pa.Table) -> pa.Table:
        cell = group.column("cell").to_numpy(zero_copy_only=False).astype(float)
        asks = np.isnan(cell)
        ids, x = group.column("vec_id").to_numpy(), matrix(group.column("embedding"), width)
        qi, q, ci, c = ids[asks], x[asks], ids[~asks], x[~asks]
        by_cell = cell[~asks].astype(int)
        order = np.lexsort((ci, by_cell))
        ci, c, by_cell = ci[order], c[order], by_cell[order]
        visits = [set(v) for v in group.column("visits").filter(pa.array(asks)).to_pylist()]
        at = {int(k): slice(int(np.searchsorted(by_cell, k)), int(np.searchsorted(by_cell, k, "right"))) for k in np.unique(by_cell)}
        found: list[tuple] = []
        run = max(1, SCORES // max(1, len(ci)))
        for s in range(0, len(qi), run):
            who = range(s, min(s + run, len(qi)))
            score = np.full((len(who), len(ci)), -np.inf)
            for k, where in at.items():
                asked = [i - s for i in who if k in visits[i]]
                if asked:
                    score[asked, where] = q[s:][asked] @ c[where].T
            score[qi[s : s + len(who), None] == ci[None]] = -np.inf
            for i in who:
                row = score[i - s]
                least = np.partition(row, -neighbours)[-neighbours] if len(row) > neighbours else -np.inf
                # everything at the bound is compared again by one exact formula, so equal vectors tie exactly
                near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf)) if np.isfinite(least) else np.flatnonzero(row > -np.inf)
                exact = (c[near] * q[i]).sum(1)
                best = np.lexsort((ci[near], -exact))[:neighbours]
                found.append((np.full(len(best), qi[i]), ci[near][best], exact[best]))
        cat = lambda k, kind: pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0), kind)
        return pa.table({"query_id": cat(0, pa.int64()), "vec_id": cat(1, pa.int64()), "score": cat(2, pa.float64())})

    best = left.unionByName(right).groupBy("block", "part").applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """The search digest of ``embeddings``: queries are the rows whose vec_id is divisible by 20, against all rows."""
    return search(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
