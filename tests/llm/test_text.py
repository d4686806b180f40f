import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from sievelake.llm import bpe, langid, quality
from sievelake.llm.common import table

PATH, PATTERN = bpe.default_vocabulary()
RANKS = bpe.load_ranks(PATH)
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "l", "ll", "é", "漢", "1", "23", "!", "#$", "\t", "😀", "the ", " ing", "\r\n", "a" * 26, " " * 30, "<|endoftext|>", " ", "\x00"]


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digest(public, text):
    ids = public.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(16, 4), (5, 7), (1, 1), (64, 16), (16, 0)])
def test_chunks_give_what_the_whole_gives(public, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    codec, rng = bpe.Codec(RANKS, PATTERN), random.Random(1)
    for _ in range(2500):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        assert codec.encode(t) == public.encode_ordinary(t), t
        assert codec.decode(codec.encode(t)).decode() == t


#: A pattern that takes white space before a line end along, and endings in either case.
OTHER = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


def test_chunks_of_another_pattern(monkeypatch):
    other = tiktoken.Encoding("other", pat_str=OTHER, mergeable_ranks=RANKS, special_tokens={})
    monkeypatch.setattr(bpe, "CHUNK", 8)
    monkeypatch.setattr(bpe, "OVERLAP", 6)
    codec, rng = bpe.Codec(RANKS, OTHER), random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice([*PIECES, "'ll", "'", "l", "\r", " \n "]) for _ in range(rng.randint(0, 40)))
        assert codec.encode(t) == other.encode_ordinary(t), t
    with pytest.raises(ValueError):
        bpe.Codec(RANKS, r"\p{L}+").encode("a b")


def test_most_texts_take_several_chunks(spark, public):
    texts = [r[0] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert np.mean([len(t) > bpe.CHUNK for t in texts]) > 0.5
    codec, meets = bpe.Codec(RANKS, PATTERN), []
    for t in texts:
        assert codec.encode(t) == public.encode_ordinary(t)
    plain = bpe.Codec._anew
    bpe.Codec._anew = lambda self, *a: meets.append(a) or plain(self, *a)
    try:
        for t in texts[:300]:
            codec.ids(t)
    finally:
        bpe.Codec._anew = plain
    assert not meets  # chunks of prose always have a boundary in common


@pytest.mark.parametrize("n", [1, 2, 64, 65, 66, 300, 5000])
def test_long_pretokens(public, n):
    codec = bpe.Codec(RANKS, PATTERN)
    for unit in ("a", "ab", "thequick", "é"):
        t = (unit * n)[:n]
        assert codec.encode(t) == public.encode_ordinary(t)


def test_cache_may_overflow(public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(RANKS, PATTERN)
    assert codec.encode("one two three four five six one two") == public.encode_ordinary("one two three four five six one two")


def test_encode_documents(spark, public):
    rng = random.Random(2)
    long = "".join(rng.choice([*PIECES, "word ", "other "]) for _ in range(90_000))
    texts = [None, "", "hello world", "hello world", long, "x" * 400_000, " " * 300_000 + "end"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1), (2, "hello world", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in bpe.encode_documents(df, PATH, PATTERN).collect()), key=repr)
    assert got == sorted(((i, *digest(public, t)) for i, t, _ in rows), key=repr)
    assert len(long) > bpe.CHUNK
    assert bpe.encode_documents(df.limit(0), PATH, PATTERN).count() == 0


def test_ids_decode_to_the_text(spark, public):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, None), (3, "é漢😀\n\n", "k0")], "doc_id long, text string, _text string")
    encoded = bpe.encode(df, ["doc_id", "_text"], PATH, PATTERN)
    assert encoded.columns == ["doc_id", "_text", "n_tokens", "ids"]
    back = {r["doc_id"]: r for r in bpe.decode(encoded, PATH).collect()}
    assert {i: r["text"] for i, r in back.items()} == {1: "one two", 2: "", 3: "é漢😀\n\n"}
    assert back[1]["ids"] == public.encode_ordinary("one two") and back[3]["_text"] == "k0"
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), ["ids"], PATH, PATTERN)
    with pytest.raises(ValueError):
        bpe.decode(back_again := encoded.withColumn("Text", F.lit(1)), PATH)
    assert bpe.decode(back_again, PATH, text="said").where("doc_id = 1").first()["said"] == "one two"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    own = [i for i in labels if held(i)]
    assert all(got[i]["held_out"] == held(i) for i in got)
    assert np.mean([got[i]["predicted"] == labels[i] for i in own]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    # held-out labels teach nothing
    flipped = table(spark, sf, "labels").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_documents(table(spark, sf, "documents"), flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in again)
    kept = quality.keep_good(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, r in got.items() if r["predicted"])


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = [rng.normal(0, 1, (400, d)) @ rng.normal(0, 1, (d, d)) + k for k in (0, 1)]
    model = quality.Discriminant.fit(np.array([400.0, 400.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), own=1.0, pooled=0.0)
    log = []
    for a in x:
        cov = np.cov(a.T, bias=True)
        z = x[0][:20] - a.mean(0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(x[0][:20]), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "word " * 2000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(df, labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(df, one).count() == 4
    assert quality.score_documents(df.limit(0), one).count() == 0
    assert quality.keep_good(df, one).columns == df.columns


def test_gradients():
    net = langid.Network.new(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(97, 123, (3, 7)).astype(np.uint8), np.array([0, 1, 2]), rng.random((3, 7))
    _, grads = net.loss_and_gradients(x, y, w)
    for p, g in zip(net.params(), grads):
        at = (x[0, 3], 5) if p.shape[0] == 256 else tuple(int(rng.integers(0, s)) for s in p.shape)
        old, losses = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = old + step
            losses.append(net.loss_and_gradients(x, y, w)[0])
        p[at] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-8)


def test_runner_equals_training_network():
    net = langid.Network.new(["a", "b"], seed=4)
    x = np.random.default_rng(1).integers(97, 123, (5, langid.WINDOW)).astype(np.uint8)
    p = net.ready().positions(np.ascontiguousarray(x.T))
    weight = np.ones(x.shape)
    for k in range(2):
        loss, _ = net.loss_and_gradients(x, np.full(5, k), weight)
        assert -np.log(p[:, k, :]).mean() == pytest.approx(loss, rel=1e-4)


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    own = [i for i in lang if held(i)]
    assert all(got[i]["held_out"] == held(i) for i in got)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in own]) > 0.97


def test_language_edges(spark):
    rows = [(i, w * 40, lang) for i, (w, lang) in enumerate([("the cat and ", "en"), ("für über ß ", "de")] * 30)] + [(900, None, "en"), (901, "", None), (902, "123 !? 😀", "de"), (None, "the cat and", None), (0, "the cat and " * 40, "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify_documents(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None]["held_out"] is (zlib.crc32(b"") % 5 == 0) and by[1]["lang_pred"] == "de" and by[2]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify_documents(df.limit(0)).count() == 0
    kept = langid.keep_sure(df)
    assert kept.columns == df.columns and kept.where("doc_id in (900, 901, 902)").count() == 0


def test_stage_keeps_by_score(spark):
    """What stays is what identify_documents scores ``times`` / L or more, for any number of languages; texts half and half must go."""
    words = {"en": "the cat and ", "de": "für über ß ", "fr": "où ça déjà ", "pl": "żółw gęś "}
    for n, mixed in ((1, False), (2, True), (4, True)):
        own = list(words.items())[:n]
        rows = [(i, w * 40, lang) for i, (lang, w) in enumerate(own * 30)] + [(900, "123 !?", "en")]
        rows += [(1000 + k, "".join(w * k for _, w in own), None) for k in (1, 6, 11, 22)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        score = {r["doc_id"]: r["score"] for r in langid.identify_documents(df).collect()}
        kept = {r["doc_id"] for r in langid.keep_sure(df).collect()}
        assert kept == {i for i, s in score.items() if s > 0 and (n == 1 or s >= 1.4 / n)}
        assert set(range(len(own) * 30)) <= kept and 900 not in kept
        gone = {i for i in score if i >= 1000} - kept
        assert bool(gone) == mixed, score


def test_language_is_learnt_from_whole_texts(spark):
    """What tells the two languages apart stands behind byte 4096 of every training text."""
    same = "12 34 abc abc. " * 400
    words = {"en": "the cat and the dog went ", "de": "und der hund lief nach "}
    rows = [(i, same + w * 120, lang) for i, (lang, w) in enumerate(list(words.items()) * 12)]
    rows += [(1000 + k, w * 3, None) for k, w in enumerate(words.values())]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(same) > 4096 and [got[1000], got[1001]] == ["en", "de"]


def test_language_sample_is_bounded_and_settled(spark):
    rows = [(i % 7, f"text {i} of many", f"l{i % 3}") for i in range(600)] + [(2, "text", None), (3, None, "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    took = langid.sample(df.repartition(5), per_lang=10)
    assert sorted(map(tuple, took)) == sorted(map(tuple, langid.sample(df.orderBy("text"), per_lang=10)))
    assert {r["lang"] for r in took} == {"l0", "l1", "l2"} and len(took) == 30
    assert all(not held(i) for i, t, _ in rows if t in {r["text"] for r in took})
    with pytest.raises(ValueError):
        langid.sample(df, languages=2)
    with pytest.raises(ValueError):
        langid.with_language(df.withColumn("Score", F.lit(1)), None, ["Score"])
    assert langid.with_language(df.withColumnRenamed("doc_id", "_text"), None, ["_text", "lang"]).columns == ["_text", "lang", "lang_pred", "score"]


def test_pooled_probabilities_cover_a_long_text():
    """The document's probabilities are the mean over the letters of all windows, computed one window at a time."""
    net = langid.Network.new(["a", "b", "c"], seed=2)
    run, rng = net.ready(), np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 255, n).astype(np.uint8)) for n in (1, 63, 64, 65, 200_000)]
    got = run.documents(texts)
    for t, p in zip(texts, got):
        x = langid.training_windows(t)
        own = np.concatenate([run.positions(np.ascontiguousarray(w[None].T))[:, :, 0] for w in x])
        letters = langid._LETTER[x.ravel()] > 0
        assert np.allclose(p, own[letters].mean(0) if letters.any() else 1 / 3, atol=1e-4)


def plain_statistics(text):
    """The statistics of a text, from its characters and words one by one."""
    raw = text.encode()
    words = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw)) if w]
    odds = lambda a, b: np.log((a + 0.5) / (b - a + 0.5))
    marks = b".,;:'\"-?()"
    upper, digits = sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw)
    letters = upper + sum(97 <= c <= 122 or c > 127 for c in raw)
    symbols = sum(not (c > 127 or chr(c).isalnum() or c in b" \t\n\x0b\x0c\r" or c in marks) for c in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {w: words.count(w) for w in set(words)} if len(words) < 3000 else __import__("collections").Counter(words)
    odd = sum(not w.strip(marks).isalnum() and max(w) < 128 for w in words)
    return [
        np.log(1 + len(words)), np.log(1 + len(raw) / (len(words) + 1)), odds(upper, letters), odds(digits, len(raw)), odds(symbols, len(raw)), odds(sum(c in marks for c in raw), len(raw)),
        np.log((len(lines) + 1) / (len(words) + 1)), np.log(1 + len(count)) - 0.8 * np.log(1 + len(words)), odds(max(count.values(), default=0), len(words)), odds(len(lines) - len(set(lines)), len(lines)),
        odds(len(fives) - len(set(fives)), len(fives)), odds(odd, len(words)), odds(sum(len(w) > 14 for w in words), len(words)), odds(raw.count(b"|"), len(raw)), odds(sum(a == b for a, b in zip(words, words[1:])), len(words)),
    ]


def test_quality_against_a_plain_version(spark):
    """Statistics, moments, discriminant and scores, all once more without Spark."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {10**9: "", 10**9 + 1: "Long | WORD-word 12 " * 30_000}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    for i, t in texts.items():
        assert np.allclose(quality.statistics(t), x[i]), (i, t[:80])
    taught = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in x and not held(r["doc_id"])]
    a, y = np.stack([t[0] for t in taught]), np.array([t[1] for t in taught])
    z, mean, spread = None, a.mean(0), np.sqrt(np.maximum(a.var(0), 1e-6))
    z = (a - mean) / spread
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    within = sum((y == k).mean() * own[k] for k in (0, 1))
    log = []
    for k in (0, 1):
        cov = 0.95 * own[k] + 0.04 * within + 0.01 * np.trace(own[k]) / len(mean) * np.eye(len(mean))
        d = (np.stack([x[i] for i in texts]) - mean) / spread - z[y == k].mean(0)
        log.append(np.log(((y == k).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = dict(zip(texts, 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))))
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, None), (10**9 + 1, texts[10**9 + 1])], "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(both, labels).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    with pytest.raises(ValueError):
        quality.with_scores(docs, quality.Discriminant.fit(np.zeros(2), np.zeros((2, 15)), np.zeros((2, 15, 15))), ["score"])
