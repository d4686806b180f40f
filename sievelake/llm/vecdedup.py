"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Unit vectors x with cosine 0.98 are 0.2 apart. A table hashes x to floor((a.x + b) / W) for k normal directions a; vectors share its
bucket if all k values agree. With L tables a link of the least cosine is missed with probability (1 - p^k)^L, p the chance that one
value agrees; L follows from k, W and MISS. k and W are chosen together, for the least to move and compare: more values make
buckets purer, but ask for more tables. Directions and vectors are rounded to fixed point, so that a key is the same
wherever it is computed: keys are never stored, and a worker computes again those of the few rows that it needs.

Equal vectors are one node with a weight. Which bucket a vector meets others in is settled on narrow rows (node, table, key); the vector
joins those that are left, once for each. Buckets above PART rows are cut into parts, and every pair of parts is one piece
of work and one group, so that no task holds a whole hot bucket; small buckets share groups of about BATCH rows. Inside a
piece all cosines are matrix products; only sums (links by vector) and a spanning forest leave it, never pairs. A pair that several tables find
counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .graph import components
from .vectors import matrix, usable

#: Chance to miss a link of exactly the least cosine; vectors in a part of a bucket; rows of one group of small buckets.
MISS, PART, BATCH = 1e-5, 2048, 20_000
#: Bucket widths to choose from; what a narrow row, a row with its vector and a product of two vectors cost, in bytes moved.
WIDTHS, NARROW, WIDE, PRODUCT = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0), 40, 320, 4
#: Fixed point: bits after the point of a unit vector's components and of a direction's. A product of both, summed, is exact in a double.
UNIT_BITS, WAY_BITS = 20, 10
#: Buckets of so few rows are worked off many at a time; pairs that are looked at together.
SMALL, PAIRS = 16, 1 << 14


class Plan(NamedTuple):
    values: int
    tables: int
    width: float


def share_probability(distance: float, width: float) -> float:
    """Probability that one p-stable hash value of two points at this distance agrees."""
    r = width / max(distance, 1e-12)
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(partners: float, least: float) -> Plan:
    """Values a table, tables and bucket width for a vector that has so many others to be told from, at right angles on average."""
    distance, best = math.sqrt(max(0.0, 2 * (1 - least))), None
    for width in WIDTHS:
        near, far = share_probability(distance, width), share_probability(math.sqrt(2), width)
        for k in range(1, 65):
            hit = min(near**k, 1 - 1e-12)
            tables = math.ceil(math.log(MISS) / math.log1p(-hit)) if hit > 1e-9 else 1 << 30
            mates = partners * far**k  # others in a bucket that are no links
            cost = tables * (NARROW + WIDE * min(1.0, mates) * max(1.0, mates / PART) + PRODUCT * mates)
            if best is None or cost < best[0]:
                best = cost, Plan(k, tables, width)
    return best[1]


class Hasher:
    """Bucket keys of unit vectors of one length."""

    def __init__(self, plan: Plan, size: int, seed: int):
        rng = np.random.default_rng([seed, size])
        self.plan, self.size, n = plan, size, plan.values * plan.tables
        self.ways = np.round(rng.normal(size=(size, n)) / plan.width * (1 << WAY_BITS))
        self.shifts = np.round(rng.uniform(0, 1, n) * (1 << (UNIT_BITS + WAY_BITS)))

    def keys(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """(rows, tables): the values of a table, its number, the label and the vector's length mixed into 64 bits."""
        k, tables, _ = self.plan
        # whole numbers below 2^53: the sums are exact in any order
        cells = np.floor((np.round(unit * (1 << UNIT_BITS)) @ self.ways + self.shifts) / (1 << (UNIT_BITS + WAY_BITS))).astype(np.int64).view(np.uint64)
        mix = np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros((len(unit), tables), np.uint64) ^ (labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
        out += np.arange(tables, dtype=np.uint64) + np.uint64(self.size * 65537)
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * mix + cells[:, i::k]
        out = (out ^ (out >> np.uint64(29))) * mix
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length among vectors."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, _unit(matrix(vectors if len(own) == len(sizes) else vectors.take(pa.array(own))))


def _list_array(column: pa.ChunkedArray) -> pa.ListArray:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of links (a, b) that are not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return nodes[low != np.arange(len(low))], nodes[low[low != np.arange(len(low))]]
        low = new


def _near_pairs(x: np.ndarray, pieces: list[np.ndarray], apart: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one piece with a product near ``least`` or above. Rows with the same ``apart`` (-1: none) don't meet: they meet elsewhere."""
    by_size: dict[int, list[np.ndarray]] = {}
    for rows in pieces:
        if len(rows) <= SMALL:
            by_size.setdefault(len(rows), []).append(rows)
            continue
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            near = x[own] @ x[rows[at:]].T >= least - 1e-9
            near &= (apart[own][:, None] != apart[rows[at:]][None]) | (apart[own][:, None] < 0)
            u, v = np.nonzero(np.triu(near, 1))
            yield own[u], rows[at:][v]
    for size, all_rows in by_size.items():
        for at in range(0, len(all_rows), 4096):
            own = np.stack(all_rows[at : at + 4096])
            some = x[own]
            near = np.triu(some @ some.transpose(0, 2, 1) >= least - 1e-9, 1)
            near &= (apart[own][:, :, None] != apart[own][:, None]) | (apart[own][:, :, None] < 0)
            piece, u, v = np.nonzero(near)
            yield own[piece, u], own[piece, v]


def link_counts(rows: DataFrame, least: float, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """From distinct vectors (node long, label, vector, weight): (node, links) and links (a, b) that span the components."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s")).first()
    chosen = plan((sizes["s"] or 0.0) / (sizes["n"] or 1.0), least)
    rows = rows.select("node", F.xxhash64("label").alias("label"), "vector", "weight")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                label, node = batch.column("label").to_numpy(), batch.column("node").to_numpy()
                for own, x in _by_length(_list_array(pa.chunked_array([batch.column("vector")]))):
                    hasher = hashers.setdefault(x.shape[1], Hasher(chosen, x.shape[1], seed))
                    keys = hasher.keys(x, label[own])
                    t = np.tile(np.arange(chosen.tables, dtype=np.int32), len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[own], chosen.tables)), pa.array(t), pa.array(keys.ravel())], ["node", "t", "key"])

    single = rows.select("node", "label", "vector").mapInArrow(hashed, "node long, t int, key long")
    crowd = single.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    crowd = written(crowd.select(F.col("key").alias("_k"), "c", F.expr(f"cast((c + {PART - 1}) div {PART} as int)").alias("parts")), "buckets")
    batches = max(1, -(-(crowd.agg(F.sum(F.col("c") * F.col("parts"))).first()[0] or 0) // BATCH))
    met = single.join(crowd, F.col("key") == F.col("_k")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    paired = met.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).select("node", "t", "key", "parts", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))
    # a pair of parts of a crowded bucket is a group of its own, small buckets share groups
    shard = F.when(F.col("parts") > 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(batches)))
    work = paired.select(F.col("node").alias("_n"), "t", "key", "p", "i", "j", shard.alias("shard")).join(rows, F.col("_n") == F.col("node")).drop("_n")

    def check(group: pa.Table) -> pa.Table:
        node, label, weight, p, i, j, t, key = (group.column(c).to_numpy() for c in ("node", "label", "weight", "p", "i", "j", "t", "key"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, x in _by_length(_list_array(group.column("vector"))):
            n, hasher = len(own), Hasher(chosen, x.shape[1], seed)
            order = np.lexsort((j[own], i[own], key[own]))
            new = np.zeros(n, bool)
            for c in (key, i, j):
                new[1:] |= c[own][order][1:] != c[own][order][:-1]
            pieces = [r for r in np.split(order, np.flatnonzero(new)) if len(r) > 1]
            apart = np.where(i[own] != j[own], p[own], -1)
            keys, known, links = np.zeros((n, chosen.tables), np.int64), np.zeros(n, bool), np.zeros(n)
            for u, v in _near_pairs(x, pieces, apart, least):
                ends = []
                for at in range(0, len(u), PAIRS):
                    a, b = u[at : at + PAIRS], v[at : at + PAIRS]
                    # the exact measure decides near the bound
                    sure = np.einsum("ij,ij->i", x[a], x[b]) >= least
                    a, b = a[sure], b[sure]
                    ends.append((a, b))
                    need = np.unique(np.concatenate([a, b]))
                    need = need[~known[need]]
                    if len(need):
                        keys[need], known[need] = hasher.keys(x[need], label[own][need]), True
                    met_before = ((keys[a] == keys[b]) & (np.arange(chosen.tables) < t[own][a][:, None])).any(1)
                    a, b = a[~met_before], b[~met_before]
                    links += np.bincount(a, weight[own][b], n) + np.bincount(b, weight[own][a], n)
                a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
                leaf, root = _forest(node[own][a], node[own][b])
                out.append((leaf, np.zeros(len(leaf), np.int64), root))
            some = np.flatnonzero(links)
            out.append((node[own][some], links[some].astype(np.int64), node[own][some]))
        cat = lambda c: pa.array(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64), pa.int64())
        return pa.table({"node": cat(0), "links": cat(1), "root": cat(2)})

    found = written(work.groupBy("shard").applyInArrow(check, "node long, links long, root long"), "vector-links")
    discard(crowd)
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")


def dedup_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label).

    Linked: equal labels, cosine of ``least`` or more. Vectors or labels that are null, zero vectors and those holding null or
    non-finite components link with nothing: 0 links, their own component, kept. Rows without an id likewise (component null).
    Rows that repeat an id with the same label and vector are one vector, whose rows say the same; an id with two vectors is a node of
    either. Other columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ok = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(ok)
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight")), "vector-classes")
    links, edges = link_counts(classes.select("node", "label", F.col("embedding").alias("vector"), "weight"), least)
    of_node = components(edges).select(F.col("node").alias("_n"), "component")
    whole = (
        classes.join(links.select(F.col("node").alias("_l"), "links"), F.col("node") == F.col("_l"), "left")
        .join(of_node, F.col("node") == F.col("_n"), "left")
        .select(
            F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = good.join(whole, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
