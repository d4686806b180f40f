"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A shingle is a run of five words (all words of a shorter text); its weight is its count in the document (tf) times its inverse
document frequency, log((1 + s) n / (df + s n)) + 1 with the smoothing share s = SMOOTH. With the usual smoothing of one document, a group
of near copies would push itself apart: what its members share is frequent by their own number, what edits changed is not. With
a share of the corpus, only shingles in percents of all documents (license lines, headers) weigh less. That is also why a
table of fixed size, SLOTS hashed slots, is exact enough at any size of the corpus: what falls into a slot by chance
is far below s n. Copies of one word sequence that hold more than HEAVY of the corpus count once.

1. One pass over all texts: a 128-bit hash of each word sequence, and the document frequencies. Equal word sequences are one class.
2. HASHES consistent weighted samples, in BANDS of ROWS; classes that share a band meet in its bucket. Inside a bucket only pairs
   whose samples agree often enough (ESTIMATE) are candidates; what leaves it is a spanning forest, never pairs.
3. Candidate components are the units of exact work: the texts of one component come together (cut into parts and pairs of
   parts where there are many or long ones), and the weighted Jaccard similarity of all pairs in them is computed exactly. Again
   only spanning links leave. Their components are the groups of near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, light, small_batches, written
from .graph import components

SIMILARITY, WORDS = 0.8, 5
#: P(no shared band) at similarity 0.8: (1 - 0.8^3)^14 = 4e-5.
BANDS, ROWS = 14, 3
HASHES = BANDS * ROWS
#: Samples of HASHES that must agree: at similarity 0.8 fewer do with probability 7e-4; pairs near 0.5 rarely get so far.
ESTIMATE = 25
#: Slots of the table of document frequencies, share of the corpus that smooths them, share from which copies count once.
SLOTS, SMOOTH, HEAVY = 1 << 20, 0.1, 1e-4
_SLOT = np.uint64(44)
#: Classes in a part of a bucket, classes and text bytes in a part of a component, classes in one group of small buckets.
BUCKET_PART, PART, PART_BYTES, BATCH = 2048, 1024, 8 << 20, 16_384
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a task's word cache; when full it is emptied.
CACHE = 100_000


class Shingler:
    """Words and weighted shingles of texts, with a bounded cache of word hashes."""

    def __init__(self, idf: np.ndarray | None = None):
        import xxhash

        self.hash, self.seen, self.idf = xxhash.xxh3_64_intdigest, {}, idf

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words in order: ASCII capitals lowered, split at ASCII white space."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, f, out = self.seen, self.hash, []
        for w in raw.lower().split():
            h = seen.get(w)
            if h is None:
                h = seen[w] = f(w)
            out.append(h)
        return np.array(out, np.uint64)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """The shingles in order, with repeats."""
        n = len(words)
        k = min(WORDS, n)
        h = np.full(n - k + 1 if n else 0, np.uint64(k))
        for i in range(k):
            h = (h ^ (h >> np.uint64(31))) * _MIX + words[i : n - k + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different shingles (sorted), their counts and their idf."""
        ids, counts = np.unique(self.hashes(words), return_counts=True)
        return ids, counts, self.idf[(ids >> _SLOT).astype(np.intp)].astype(np.float64)


class Sampler:
    """Improved consistent weighted sampling: for each hash, the shingle (and level) of least value.

    r and c are gamma(2, 1) and beta uniform. They are drawn by three different fields of the shingle's 64-bit hash times the hash
    function's odd multiplier, so that shingles of a set of any size hardly ever share all three; equal values go to the smaller shingle.
    """

    def __init__(self, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.b = rng.random(1 << 16, np.float32)
        self.odd = rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, ids: np.ndarray, weights: np.ndarray, width: int = 1 << 15) -> np.ndarray:
        """HASHES 64-bit samples of one weighted set, ``width`` shingles at a time."""
        low, out = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.uint64)
        log, each = np.log(weights).astype(np.float32), np.arange(HASHES)
        for at in range(0, len(ids), width):
            own = ids[at : at + width]
            mixed = own[None] * self.odd[:, None]
            mixed ^= mixed >> np.uint64(32)
            fields = mixed.view(np.uint16).reshape(HASHES, len(own), 4)
            r, b, c = self.r[fields[..., 0]], self.b[fields[..., 1]], self.c[fields[..., 2]]
            t = np.floor(log[None, at : at + width] / r + b)
            value = c - r * (t - b) - r
            best = value.argmin(1)
            found = value[each, best]
            level = t[each, best].astype(np.int64).view(np.uint64)
            new = found < low
            out[new], low[new] = ((own[best] ^ (level * np.uint64(0xC2B2AE3D27D4EB4F))) * _MIX)[new], found[new]
        return out ^ (out >> np.uint64(29))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _counts(found: np.ndarray) -> list[pa.Array]:
    at = np.flatnonzero(found)
    return [pa.array(at, pa.int32()), pa.array(found[at])]


def _digest(words: np.ndarray) -> tuple[int | None, int | None]:
    """128-bit hash of a word sequence in two halves; null without words."""
    import xxhash

    if not len(words):
        return None, None
    d = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def first_pass(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (x, text) x, hi and lo (its ``_digest``), and besides rows (slot, n): in how many documents a slot has shingles."""
    names = ["x", "hi", "lo", "slot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, found = Shingler(), np.zeros(SLOTS, np.int64)
        for batch in light(batches, "text"):
            keys = []
            for t in _texts(batch):
                words = shingler.words(t)
                keys.append(_digest(words))
                found[np.unique(shingler.hashes(words) >> _SLOT).astype(np.intp)] += 1
            none = pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x"), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], *none], names)
        slot, n = _counts(found)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(slot), pa.int64())] * 3, slot, n], names)

    return docs.select("x", "text").mapInArrow(run, "x long, hi long, lo long, slot int, n long")


def shingle_idf(docs: DataFrame, seen: DataFrame) -> np.ndarray:
    """idf of each slot from the rows of ``first_pass``; at most SLOTS rows reach the driver.

    Of a word sequence that more than HEAVY of all documents are, all but one are taken off again: there are at most
    1 / HEAVY of these, so their hashes may be broadcast, and one text of each is read.
    """
    n = seen.where("hi is not null").count()
    got = seen.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS)
    df[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    same = seen.where("hi is not null").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("_x"))
    heavy = written(same.where((F.col("c") > 1) & (F.col("c") > HEAVY * n)).select("_x", (F.col("c") - 1).alias("more")), "heavy")
    texts = docs.join(F.broadcast(heavy), F.col("x") == F.col("_x")).groupBy("x").agg(F.min("text").alias("text"), F.min("more").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, found = Shingler(), np.zeros(SLOTS, np.int64)
        for batch in light(batches, "text"):
            for t, more in zip(_texts(batch), batch.column("more").to_pylist()):
                found[np.unique(shingler.hashes(shingler.words(t)) >> _SLOT).astype(np.intp)] += more
        yield pa.RecordBatch.from_arrays(_counts(found), ["slot", "n"])

    off = texts.select("text", "more").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df[off.column("slot").to_numpy()] -= off.column("n").to_numpy()
    n -= heavy.agg(F.sum("more")).first()[0] or 0
    discard(heavy)
    return (np.log((1 + SMOOTH) * max(n, 1) / (df + SMOOTH * max(n, 1))) + 1).astype(np.float32)


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, x, hi, lo and samples, one row per row of ``docs``; samples are null where the task has made those of the same words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, made = Shingler(idf.value), Sampler(), set()
        for batch in light(batches, "text"):
            keys, samples = [], []
            for t in _texts(batch):
                words = shingler.words(t)
                keys.append(key := _digest(words))
                if key in made or not len(words):
                    samples.append(None)
                    continue
                if len(made) > CACHE:
                    made.clear()
                made.add(key)
                ids, counts, weight = shingler.shingles(words)
                samples.append(sampler.samples(ids, counts * weight).tobytes())
            halves = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x"), *halves, pa.array(samples, pa.binary())], ["doc_id", "x", "hi", "lo", "samples"])

    return docs.select("doc_id", "x", "text").mapInArrow(run, "doc_id long, x long, hi long, lo long, samples binary")


def _roots(n: int, u: np.ndarray, v: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node of each one's component under the links (u, v)."""
    low = nodes.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        if (new == low).all():
            return low
        low = new


def _spanning(nodes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes that the upper triangle ``near`` moves: a star for each component."""
    u, v = np.nonzero(near)
    root = _roots(len(nodes), u, v, nodes)
    moved = root != nodes
    return nodes[moved], root[moved]


_EDGES = "a long, b long"


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    cat = lambda k: pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64), pa.int64())
    return pa.table({"a": cat(0), "b": cat(1)})


def _groups(*keys: np.ndarray):
    """Index runs of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    cut = np.flatnonzero(new)
    yield from np.split(order, cut[1:])


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that span the candidate components of classes (node, samples): shared band, ESTIMATE samples alike."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("samples").to_pylist()), np.uint64).reshape(-1, BANDS, ROWS)
            key = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                key = (key ^ (key >> np.uint64(31))) * _MIX + s[:, :, i]
            key = (key ^ (key >> np.uint64(32))) * _MIX
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))], ["node", "key"])

    keys = written(classes.select("node", "samples").mapInArrow(band, "node long, key long"), "bands")
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("_k"), F.expr(f"cast((c + {BUCKET_PART - 1}) div {BUCKET_PART} as int)").alias("parts"))
    met = written(keys.join(crowd, F.col("key") == F.col("_k")).select("node", "key", "parts"), "buckets")
    discard(keys)
    batches = max(1, -(-met.where("parts = 1").count() // BATCH))
    pieces = met.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    # a pair of parts of a crowded bucket is a group of its own, small buckets share groups
    i, j = F.least("p", "o"), F.greatest("p", "o")
    shard = F.when(F.col("parts") > 1, F.xxhash64("key", i, j)).otherwise(F.pmod(F.xxhash64("key"), F.lit(batches)))
    pieces = pieces.select("node", "key", "p", i.alias("i"), j.alias("j"), shard.alias("shard"))
    own = classes.select(F.col("node").alias("_n"), "samples")
    work = pieces.join(own, F.col("node") == F.col("_n")).drop("_n")

    def check(group: pa.Table) -> pa.Table:
        node, key, p, i, j = (group.column(c).to_numpy() for c in ("node", "key", "p", "i", "j"))
        samples = np.frombuffer(b"".join(group.column("samples").to_pylist()), np.uint64).reshape(-1, HASHES)
        short = (samples & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        found = []
        for rows in _groups(key, i, j):
            if len(rows) < 2:
                continue
            alike = np.zeros((len(rows), len(rows)), np.uint8)
            for h in range(HASHES):
                x = short[rows, h]
                alike += x[:, None] == x[None]
            near = np.triu(alike >= ESTIMATE, 1)
            if i[rows[0]] != j[rows[0]]:
                near &= p[rows][:, None] != p[rows][None]
            found.append(_spanning(node[rows], near))
        return _edges(found)

    return work.groupBy("shard").applyInArrow(check, _EDGES)


def exact_links(texts: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) that span the groups of similarity ``least`` in texts (node, text, component)."""
    size = F.octet_length("text").cast("long")
    sizes = texts.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("b"))
    sizes = sizes.select(F.col("component").alias("_c"), F.greatest(F.expr(f"cast((c + {PART - 1}) div {PART} as int)"), F.expr(f"cast((b + {PART_BYTES - 1}) div {PART_BYTES} as int)")).alias("parts"))
    total = texts.agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("b")).first()
    batches = max(1, -(-total["c"] // PART), -(-(total["b"] or 0) // PART_BYTES))
    met = texts.join(sizes, F.col("component") == F.col("_c")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    # a small component shares its batch with others, a pair of parts of a large one is a batch of its own
    i, j = F.least("p", "o"), F.greatest("p", "o")
    shard = F.when(F.col("parts") > 1, F.xxhash64("component", i, j)).otherwise(F.pmod(F.xxhash64("component"), F.lit(batches)))
    work = met.select("node", "text", "component", "p", i.alias("i"), j.alias("j"), shard.alias("shard"))

    def check(group: pa.Table) -> pa.Table:
        shingler, found = Shingler(idf.value), []
        node, component, p, i, j = (group.column(c).to_numpy() for c in ("node", "component", "p", "i", "j"))
        text = group.column("text").cast(pa.large_binary()).combine_chunks()
        for rows in _groups(component, i, j):
            if len(rows) < 2:
                continue
            sets = [shingler.shingles(shingler.words(text[int(r)].as_py())) for r in rows]
            near = np.triu(similarities(sets) >= least, 1)
            if i[rows[0]] != j[rows[0]]:
                near &= p[rows][:, None] != p[rows][None]
            found.append(_spanning(node[rows], near))
        return _edges(found)

    return work.groupBy("shard").applyInArrow(check, _EDGES)


def similarities(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of (shingles, counts, idf): sum of least weights over sum of largest.

    A shingle that occurs n times is n features of its idf, numbered 1 to n; the least of two counts is then the number of features
    that both have, and all pairs are matrix products over features that at least two sets have, ``width`` at a time.
    """
    n = len(sets)
    ids = np.concatenate([np.repeat(s[0], s[1]) for s in sets])
    turn = np.concatenate([np.concatenate([np.arange(c) for c in s[1]]) if (s[1] > 1).any() else np.zeros(len(s[0]), np.int64) for s in sets])
    idf = np.concatenate([np.repeat(s[2], s[1]) for s in sets])
    owner = np.repeat(np.arange(n), [int(s[1].sum()) for s in sets])
    total = np.bincount(owner, idf, n)
    feature = (ids ^ (turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _MIX
    _, first, back, times = np.unique(feature, return_index=True, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[back]
    rows, cols, weight = owner[keep], column[back][keep], np.sqrt(idf[first])[shared]
    least = np.zeros((n, n))
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, len(weight), width):
        a, b = np.searchsorted(cols, [at, at + width])
        dense = np.zeros((n, min(width, len(weight) - at)), np.float32)
        dense[rows[a:b], cols[a:b] - at] = weight[cols[a:b]]
        least += dense @ dense.T
    union = total[:, None] + total[None] - least
    return least / np.maximum(union, 1e-12)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copy_id, kept: one row per row of ``docs`` (doc_id, text).

    class_id: the smallest id among documents linked, directly or by others, with weighted Jaccard similarity of ``least`` or
    more; copy_id: the smallest id among documents of the same words in the same order (case of A-Z and white space aside);
    kept: doc_id = class_id. Null texts and texts without words link with nothing; rows without an id are kept, with
    null class and copy. Rows that repeat an id are judged each by its own text. Other columns are ignored; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    # x tells the texts of a repeated id apart
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    seen = written(first_pass(rows), "first-pass")
    idf = docs.sparkSession.sparkContext.broadcast(shingle_idf(rows, seen))  # SLOTS floats: 4 MB at every size of the input
    discard(seen)
    signed = written(_signatures(rows, idf), "signatures")
    with_words = signed.where("hi is not null and doc_id is not null")
    # a class goes by a number of its own, and by the id and text of its first row
    same = signed.where("hi is not null").groupBy("hi", "lo").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "x"))).alias("first"), F.first("samples", True).alias("samples"))
    classes = written(same.where("first is not null").select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "first.doc_id", "first.x", "samples"), "classes")
    hopeful = components(links := written(candidate_links(classes), "candidates"))
    discard(links)
    wanted = hopeful.join(classes, "node").select("node", "component", F.col("doc_id").alias("_d"), F.col("x").alias("_x"))
    of_class = (F.col("doc_id") == F.col("_d")) & (F.col("x") == F.col("_x"))
    texts = written(rows.join(wanted, of_class).groupBy("node", "component").agg(F.min("text").alias("text")), "candidate-texts")
    groups = components(links := written(exact_links(texts, idf, least), "near"))
    discard(links, texts, hopeful)
    low = groups.join(classes, "node").groupBy("component").agg(F.min("doc_id").alias("low"))
    group = groups.join(low, "component").select(F.col("node").alias("_g"), "low")
    whole = classes.join(group, F.col("node") == F.col("_g"), "left").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("doc_id").alias("copy_id"), F.coalesce("low", "doc_id").alias("class_id"))
    linked = with_words.join(whole, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).select("doc_id", "class_id", "copy_id")
    alone = signed.where("hi is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that of smallest id (null ids last). The columns are those of ``docs``.

    Rows are told apart by a written number, not by their ids: of rows that repeat an id, or have none, one stays where they are near
    copies, and an id with different texts loses only the rows that are copies. Null texts and texts without words all stay.
    """
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_n"), F.struct(*docs.columns).alias("_doc")), "numbered")
    groups = near_duplicates(numbered.select(F.col("_n").alias("doc_id"), F.col("_doc.text").alias("text")), least).select(F.col("doc_id").alias("_m"), "class_id")
    ids = numbered.select("_n", F.col("_doc.doc_id").alias("doc_id"))
    found = written(groups.join(ids, F.col("_m") == F.col("_n")).select("_n", "doc_id", "class_id"), "groups")
    stay = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_n")).alias("_first")).select("_first._n")
    gone = found.select("_n").join(stay, "_n", "left_anti")
    return numbered.join(gone, "_n", "left_anti").select("_doc.*")
