"""LM scoring: prediction by partial matching over bytes, pretrained on the training documents.

The model is a trie of byte contexts of up to ORDER bytes. A symbol seen in the longest context gets (n - 1/2) / T (T: symbols counted
there, q: different ones; escape method D); otherwise the model escapes with (q / 2) / T to the next shorter context, where
the symbols of the longer one are excluded, and at last to all remaining byte values alike. Since all symbols of a
context also stand in its shorter ones, what is excluded depends on the last context alone. So every (ORDER+1)-gram has one
log probability, found level by level with joins and windows over at most 256 rows a key.

Documents are dealt into blocks. A block sends its different words and n-grams, not its positions, to be counted;
counts and log probabilities come back to the block that has them, and it scores its texts with its own dictionary.
So no table of the corpus is broadcast or collected, a word in every text costs one row a block, and memory is a block's.

A text's symbols are its UTF-8 bytes and one end mark; its first context is start marks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, default_parallelism, discard, small_batches, written

ORDER = 4
#: Text bytes of a block; positions handled at a time inside it; size of a dense lookup table, beyond which a sorted one serves.
BLOCK, SLICE, DENSE = 24 << 20, 1 << 20, 1 << 26
#: Partitions for each block, so that blocks seldom share one; from MOST partitions on each has many blocks, which is as even.
SPREAD, MOST = 8, 20_000
#: Bytes that UTF-8 never has, for the marks before a text and after it; values that a symbol can take.
START, END, SYMBOLS = 0xFF, 0xFE, 255


def blocked(docs: DataFrame, block_bytes: int = BLOCK) -> tuple[DataFrame, bool, int]:
    """doc_id, text (null: empty), train, blk; whether blocks are runs of rows in their files; and about how many blocks there are.

    Blocks are about ``block_bytes`` of text, as many as the input's bytes ask for. Rows that come from files are blocked by file and
    row number, so that one scan task holds most of a block and nothing is shuffled to count it; other rows by a hash.
    Any fixed rule gives the same scores.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, -(-(size["bytes"] or 0) // block_bytes))
    text = F.coalesce(F.col("text"), F.lit(""))
    train = crc_mod("doc_id", 7) != 2
    try:
        run = F.expr(f"_metadata.row_index div {max(1, size['rows'] // n)}")
        return docs.select("doc_id", text.alias("text"), train.alias("train"), F.xxhash64(F.col("_metadata.file_path"), run).alias("blk")), True, n
    except AnalysisException:  # not the rows of files
        blk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(17)), F.lit(n))
        return docs.select("doc_id", text.alias("text"), train.alias("train"), blk.alias("blk")), False, n


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _words(raw: bytes) -> list[bytes]:
    """Tokens without the end: ASCII capitals lowered, split at ASCII white space."""
    return raw.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter(map(f, words), np.uint64, len(words)).view(np.int64)


def _framed(texts: list[bytes]) -> np.ndarray:
    """Bytes of all texts, each after ORDER start marks and before an end mark."""
    mark, end = bytes([START]) * ORDER, bytes([END])
    return np.frombuffer(b"".join([mark + t + end for t in texts]), np.uint8)


def _slices(texts: list[bytes]):
    """The texts in runs of about SLICE bytes, with where each text's symbols end in the run."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) + ORDER + 1
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def _grams(framed: np.ndarray) -> np.ndarray:
    """The (ORDER+1)-gram that ends at each byte from ORDER on, oldest byte highest."""
    n = len(framed) - ORDER
    key = framed[:n].astype(np.int64)
    for i in range(1, ORDER + 1):
        key <<= 8
        key |= framed[i : i + n]
    return key


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.intp)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def gram_counts(texts: list[bytes], weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of texts and ``weight`` times how often each occurs."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for run in _slices(texts):
        for own in _chunks(_framed(run)):
            keys = _grams(own)
            # a gram whose last byte is a start mark runs over a text's start: no symbol
            keys = keys[(keys & 0xFF) != START]
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.intp)
            parts.append((keys[first], np.diff(np.append(first, len(keys))) * weight))
        if len(parts) > 16:
            parts = [_counted(parts)]
    return _counted(parts)


def _chunks(framed: np.ndarray):
    """A run cut where a text is longer than SLICE: pieces overlap by ORDER bytes, so every symbol is in one."""
    for i in range(0, max(1, len(framed) - ORDER), SLICE):
        yield framed[i : i + SLICE + ORDER]


_TERMS = pa.schema([("blk", pa.int64()), ("gram", pa.bool_()), ("term", pa.int64()), ("n", pa.int64())])


def _block_terms(group: pa.Table) -> pa.Table:
    """Different words and n-grams of a block and how often its training texts have them (0: only others do)."""
    texts, train = _texts(group.column("text")), group.column("train").to_pylist()
    taught = [t for t, own in zip(texts, train) if own]
    counts: Counter = Counter()
    for t in taught:
        counts.update(_words(t))
    for t, own in zip(texts, train):
        if not own:
            for w in _words(t):
                counts.setdefault(w, 0)
    words = word_hashes(list(counts))
    keys, n = _counted([gram_counts(taught, 1), gram_counts([t for t, own in zip(texts, train) if not own], 0)])
    blk = group.column("blk")[0].as_py()
    terms, all_n = np.concatenate([words, keys]), np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), n])
    gram = np.arange(len(terms)) >= len(words)
    return pa.table([pa.array(np.full(len(terms), blk, np.int64)), pa.array(gram), pa.array(terms), pa.array(all_n)], schema=_TERMS)


def _run_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block_terms of every run of rows of one block; a block that comes in several runs has several rows for a term."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        blk = batch.column("blk").to_numpy()
        cuts = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), len(blk)]
        for a, b in pairwise(cuts):
            if held and b > a and held[0].column("blk")[0].as_py() != blk[a]:
                yield from _block_terms(pa.Table.from_batches(held)).to_batches(1 << 18)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from _block_terms(pa.Table.from_batches(held)).to_batches(1 << 18)


def gram_log_probs(grams: DataFrame) -> DataFrame:
    """``term``, ``value`` (log10 probability of its last byte after the others) from ``term``, ``n`` (training count, may be 0)."""
    low = lambda c, k: c.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))  # noqa: E731  the last k bytes of context and the symbol
    levels = [grams.select(F.col("term").alias("key"), "n")]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, levels[0].groupBy(low(F.col("key"), k).alias("key")).agg(F.sum("n").alias("n")))

    def at(level: DataFrame, *more: Column) -> DataFrame:
        own = Window.partitionBy(F.shiftright("key", 8))
        return level.select("*", F.sum("n").over(own).alias("t"), F.count(F.when(F.col("n") > 0, 1)).over(own).alias("q"), *more)

    zero = at(levels[0])
    done = zero.withColumn("escaped", -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("q"), F.lit(1))))
    for k in range(1, ORDER + 1):
        up = done.select(F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("q").alias("q1"), F.col("escaped").alias("e1"))
        if k <= 2:
            up = F.broadcast(up)  # at most 256 to the power k rows
        met = levels[k].withColumn("k1", low(F.col("key"), k - 1)).join(up, "k1")
        met = at(met, F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)).over(Window.partitionBy(F.shiftright("key", 8))).alias("x"))
        left_t, left_q = F.col("t1") - F.col("x"), F.col("q1") - F.col("q")
        escape = F.when(left_q > 0, F.log10(F.try_divide(left_q / 2, left_t))).otherwise(0.0)
        value = F.when(F.col("t1") == 0, F.col("e1")).when(F.col("n1") > 0, F.log10(F.try_divide(F.col("n1") - 0.5, left_t))).otherwise(escape + F.col("e1"))
        done = met.select("key", "n", "t", "q", value.alias("escaped"))
    top = F.when(F.col("t") == 0, F.col("escaped")).when(F.col("n") > 0, F.log10(F.try_divide(F.col("n") - 0.5, F.col("t")))).otherwise(F.log10(F.try_divide(F.col("q") / 2, F.col("t"))) + F.col("escaped"))
    return done.select(F.col("key").alias("term"), top.alias("value"))


class GramTable:
    """Looks up the value of every n-gram of a run of bytes; built from the sorted different keys of a block.

    Prefixes get ids level by level, and (id, next byte) leads to the next id through a dense table: a few array reads a byte.
    Where such a table would be too large (noise), the whole key is looked up in the sorted keys: the same values.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.steps = keys, values, []
        ids = np.zeros(len(keys), np.int64)
        self.symbol = np.zeros(256, np.int64)
        used = np.unique(np.concatenate([(keys >> (8 * i)) & 0xFF for i in range(ORDER + 1)])) if len(keys) else np.zeros(0, np.int64)
        self.symbol[used] = np.arange(len(used))
        self.width, count = max(1, len(used)), 1
        for i in range(ORDER, -1, -1):
            if count * self.width > DENSE:
                self.steps = None
                return
            cell = ids * self.width + self.symbol[(keys >> (8 * i)) & 0xFF]
            new = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
            step = np.zeros(count * self.width, np.int32)
            ids = np.cumsum(new) - 1
            step[cell] = ids
            count = int(ids[-1]) + 1 if len(ids) else 1
            self.steps.append(step)

    def look(self, framed: np.ndarray) -> np.ndarray:
        """Values for the bytes of a framed run from ORDER on; all of its n-grams must be among the keys, but for start marks."""
        n = len(framed) - ORDER
        if self.steps is None:
            at = np.searchsorted(self.keys, _grams(framed))
            return self.values[np.minimum(at, len(self.keys) - 1)]
        s = self.symbol[framed]
        at = self.steps[0][s[:n]].astype(np.int64)
        for i in range(1, ORDER + 1):
            at *= self.width
            at += s[i : i + n]
            at = self.steps[i][at].astype(np.int64)
        return self.values[at]


def _log_probs(texts: list[bytes], table: GramTable) -> np.ndarray:
    """log10 probability of each text with its end."""
    out = []
    for run in _slices(texts):
        framed = _framed(run)
        found = np.concatenate([table.look(own) for own in _chunks(framed)])
        # symbol k of the run stands at byte ORDER + k; each text's first ORDER bytes are marks
        sizes = np.array([len(t) + 1 + ORDER for t in run])
        found[framed[ORDER:] == START] = 0.0
        starts = np.cumsum(sizes) - sizes
        out.append(np.add.reduceat(found, starts))
    return np.concatenate(out) if out else np.zeros(0)


_SCORES = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null and empty texts have one token, the end; null ids teach; without training texts every symbol is uniform and the
    base is that of no counts. Repeated rows all teach and all get rows. Columns besides doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    rows, in_runs, blocks = blocked(docs, block_bytes)
    schema = "blk long, gram boolean, term long, n long"
    terms = written(rows.mapInArrow(_run_terms, schema) if in_runs else rows.groupBy("blk").applyInArrow(_block_terms, schema), "lm-terms")
    words = terms.where(~F.col("gram"))
    total = words.groupBy("term").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    ends = docs.where(crc_mod("doc_id", 7) != 2).count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    grams = written(terms.where("gram").groupBy("term").agg(F.sum("n").alias("n")), "lm-grams")
    values = written(gram_log_probs(grams), "lm-values")
    discard(grams)
    known = words.select("blk", "gram", "term", F.sum("n").over(Window.partitionBy("term")).cast("double").alias("value")).where("value > 0")
    own = terms.where("gram").select("blk", "gram", "term").join(values, "term").select("blk", "gram", "term", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table, dictionary: pa.Table) -> pa.Table:
        texts = _texts(group.column("text"))
        gram = dictionary.column("gram").to_numpy().astype(bool)
        term, value = dictionary.column("term").to_numpy(), dictionary.column("value").to_numpy()
        keys, order = np.unique(term[gram], return_index=True)
        score = _log_probs(texts, GramTable(keys, value[gram][order]))
        log = lambda c: np.log10((c + 1) / (n + v + 1))
        hashes, order = np.unique(term[~gram], return_index=True)
        counts = value[~gram][order]
        known_words: dict[bytes, float] = {}
        floor, same = float(log(np.float64(0))), {}  # of unknown words; equal values are one object
        base, n_known, n_tokens = [], [], []
        for t in texts:
            w = _words(t)
            fresh = [x for x in set(w) if x not in known_words]
            if fresh:
                h = word_hashes(fresh)
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                c = np.where(hashes[at] == h, counts[at], 0.0) if len(hashes) else np.zeros(len(h))
                known_words.update((x, same.setdefault(v, v)) for x, v in zip(fresh, log(c).tolist()))
            got = [known_words[x] for x in w]
            base.append(sum(got) + float(log(np.float64(ends))))
            n_known.append(len(got) - got.count(floor) + (ends > 0))
            n_tokens.append(len(w) + 1)
        size = len(texts)
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": pa.array([not x for x in group.column("train").to_pylist()]),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n] * size, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score),
            }
        )

    parts = max(default_parallelism(docs), min(SPREAD * blocks, MOST))
    texts, dictionary = rows.repartition(parts, "blk"), known.unionByName(own).repartition(parts, "blk")
    return texts.groupBy("blk").cogroup(dictionary.groupBy("blk")).applyInArrow(run, _SCORES.format(kind))
