import collections
import math
import random
import zlib

import numpy as np
import pytest

from sievelake.llm import lm

TEXTS = [None, "", "a", "the cat sat on the mat", "The Cat  sat\non the mat", "abababab" * 30, "é漢😀 x", "\t \n", "the cat sat on the mat", "zzz " * 200] + [
    "".join(random.Random(k).choice("ab c\n") for _ in range(40)) for k in range(30)
]


def brute(rows):
    """The contract and the model, word by word and byte by byte."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts, k = collections.Counter(), lm.ORDER
    levels = [collections.defaultdict(collections.Counter) for _ in range(k + 1)]
    for i, t in raw:
        if not held(i):
            counts.update([*t.lower().split(), None])
            s = b"\xff" * k + t + b"\xfe"
            for j in range(k, len(s)):
                for o in range(k + 1):
                    levels[o][s[j - o : j]][s[j]] += 1
    n, v = sum(counts.values()), len(counts)

    def log_p(context, symbol):
        excluded, out = set(), 0.0
        for o in range(k, -1, -1):
            seen = levels[o].get(context[k - o :])
            if not seen:
                continue
            live = {a: c for a, c in seen.items() if a not in excluded}
            total = sum(live.values())
            if symbol in live:
                return out + math.log10((live[symbol] - 0.5) / total)
            if live:
                out += math.log10(len(live) / 2 / total)
            excluded = set(seen)
        return out - math.log10(255 - len(excluded))

    for i, t in raw:
        s = b"\xff" * k + t + b"\xfe"
        words = [*t.lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        yield (i, held(i), len(words), sum(counts[w] > 0 for w in words), n, base, sum(log_p(s[j - k : j], s[j]) for j in range(k, len(s))))


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9), a


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, blk int, score string").repartition(3)
    return [tuple(r) for r in lm.score_documents(df, **kw).collect()]


def test_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (5, TEXTS[5])]
    close(run(spark, rows), list(brute(rows)))


def test_block_size_changes_nothing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    close(run(spark, rows, block_bytes=200), list(brute(rows)))


def test_blocks_of_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (5, TEXTS[5])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for size in (1 << 20, 300, 10):
        assert lm.blocked(docs, size)[1]
        close([tuple(r) for r in lm.score_documents(docs, block_bytes=size).collect()], list(brute(rows)))


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice(["word ", "other ", "é ", "\n"]) for _ in range(40_000))
    rows = [(0, long), (1, "word other"), (3, long[:100_000]), (4, "x" * 150_000), (6, None)]
    close(run(spark, rows, block_bytes=100_000), list(brute(rows)))


def test_no_rows_and_no_training_rows(spark):
    assert run(spark, []) == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = run(spark, [(held, "ab")])
    assert row[:5] == (held, True, 2, 0, 0) and row[5] == 0.0
    assert row[6] == pytest.approx(3 * -math.log10(255))


def test_probabilities_of_a_context_sum_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counts = collections.Counter()
    for i, t in enumerate(TEXTS):
        s = b"\xff" * lm.ORDER + (t or "").encode() + b"\xfe"
        for j in range(lm.ORDER, len(s)):
            counts[int.from_bytes(s[j - lm.ORDER : j + 1], "big")] += 1
    context = int.from_bytes(b"cat ", "big")
    grams = [(k, n) for k, n in counts.items()] + [(context << 8 | b, 0) for b in range(255) if context << 8 | b not in counts]
    values = lm.gram_log_probs(spark.createDataFrame(grams, "term long, n long"))
    assert sum(10 ** r["value"] for r in values.collect() if r["term"] >> 8 == context) == pytest.approx(1)
    del df


def test_sorted_lookup_equals_dense(monkeypatch):
    texts = [t.encode() for t in TEXTS if t]
    keys, _ = lm.gram_counts(texts, 1)
    values = np.random.default_rng(0).normal(size=len(keys))
    dense = lm._log_probs(texts, lm.GramTable(keys, values))
    monkeypatch.setattr(lm, "DENSE", 10)
    monkeypatch.setattr(lm, "SLICE", 64)
    table = lm.GramTable(keys, values)
    assert table.steps is None
    assert np.allclose(dense, lm._log_probs(texts, table))
    again, n = lm.gram_counts(texts, 1)
    assert (again == keys).all() and n.sum() == sum(len(t) + 1 for t in texts)
