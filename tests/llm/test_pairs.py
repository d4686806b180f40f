import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import ann, graph, textdedup, vecdedup


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty", "clique"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(5, i) for i in range(6, 300)] + [(0, 5)],
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)],
        "empty": [(3, 3)],
        "clique": [(i, j) for i in range(25) for j in range(25)],
    }[kind]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(3)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = roots(nodes, [x for x in links if x[0] != x[1]])
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    for i in range(100, 400):
        k = int(rng.integers(0, 40)) if i < 250 else 3
        v = base[k] + rng.normal(scale=rng.choice([0.0, 0.05, 0.15]) * np.linalg.norm(base[k]) / 4, size=16)
        rows.append((i, (v * rng.uniform(0.5, 3)).tolist(), k % 2 if i % 9 else 1 - k % 2))
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 0), (904, base[0].tolist(), None), (905, [], 1), (906, [1.0, None] + [1.0] * 14, 1), (907, [1.0, 0.0], 0), (908, [2.0, 0.0], 0)]
    return rows + odd


def good(v, label=0):
    return v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


SCHEMA = "vec_id long, embedding array<double>, label int, node string, n_links int"


def test_vector_dedup(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    ok = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if good(v, k)]
    links = [(a, b) for x, (a, u, k) in enumerate(ok) for b, v, m in ok[x + 1 :] if k == m and len(u) == len(v) and u @ v >= 0.98]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = roots([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in vecdedup.dedup_vectors(df).collect()}
    assert len(links) > 1000
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}


def test_vector_dedup_in_parts(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    whole = sorted(map(tuple, vecdedup.dedup_vectors(df).collect()))
    monkeypatch.setattr(vecdedup, "PART", 8)
    monkeypatch.setattr(vecdedup, "BATCH", 50)
    assert sorted(map(tuple, vecdedup.dedup_vectors(df).collect())) == whole


def test_vector_dedup_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vecdedup.dedup_vectors(df).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.0], 0, "", 0), (None, [1.0, 2.0], 0, "", 0)], SCHEMA)
    got = sorted(repr(tuple(r)) for r in vecdedup.dedup_vectors(same).collect())
    assert got == sorted(map(repr, [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (None, 0, None, True)]))


def test_a_crowded_bucket_is_worked_off_in_bounded_groups(spark, monkeypatch):
    """All vectors nearly alike: every bucket is hot, yet a group has at most two parts of it or a batch of small buckets."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + rng.normal(scale=1e-3, size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(vecdedup, "PART", 50)
    monkeypatch.setattr(vecdedup, "BATCH", 100)
    most, group_by = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (most.append(rows_of_calls_of(self)) if c == ("shard",) else None) or group_by(self, *c))

    def rows_of_calls_of(frame):
        return group_by(frame, "shard").count().agg(F.max("count")).first()[0]

    got = vecdedup.dedup_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(599, 0)}
    assert most and max(most) <= 2 * 50 * 2
    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"own{i}"])) for i in range(300)], "doc_id long, text string")
    for name, value in (("PART", 40), ("BUCKET_PART", 40), ("BATCH", 100)):
        monkeypatch.setattr(textdedup, name, value)
    most.clear()
    assert {r["class_id"] for r in textdedup.near_duplicates(docs).collect()} == {0}
    assert len(most) == 2 and max(most) <= 2 * 40 * 2


def test_parts_are_equal_and_none_is_empty():
    for total, part, tasks in ((10_256, 32_768, 211), (51_282, 32_768, 12), (10**6, 32_768, 200), (1, 32_768, 8), (10**9, 32_768, 200), (0, 10, 4)):
        parts, size = ann.deal(total, part, tasks)
        assert size <= part and parts * size >= total and (total == 0 or (parts - 1) * size < total)
        assert not total or (total - 1) // size == parts - 1


def test_plan_meets_its_miss_rate():
    for n in (10, 10**5, 10**9):
        k, tables, width = vecdedup.plan(n, 0.98)
        assert (1 - vecdedup.share_probability(0.2, width) ** k) ** tables <= vecdedup.MISS


def brute_search(rows, k):
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and good(v) and len(v) == 16]
    for i, q in ok:
        if i % 20 == 0:
            found = sorted(((-float(v @ q), j) for j, v in ok if j != i))
            yield i, [(j, -s) for s, j in found[:k]]


def test_search_with_full_probe_is_exact(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    for parts in ({}, {"part": 30, "block": 4}):
        got = defaultdict(list)
        for r in ann.search(df, F.col("vec_id") % 20 == 0, probe=1.0, **parts).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        want = dict(brute_search(rows, 20))
        assert set(got) == set(want)
        for i, found in want.items():
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in found])
            assert len({j for j, _ in got[i]} & {j for j, _ in found}) >= 19


def test_search_ties_and_edges(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0, "", 0) for i in range(60)], SCHEMA)
    got = ann.search_embeddings(same).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(21) if i != 20] and {r["score"] for r in got} == {14.0}
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (1, [0.5, 0.5], 0, "", 0), (2, None, 0, "", 0)], SCHEMA)
    assert [tuple(r) for r in ann.search_embeddings(few).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search_embeddings(few.limit(0)).count() == 0
    assert ann.search_embeddings(few.where("vec_id = 0")).count() == 0


def test_search_keeps_lengths_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(5, 8, 1)[i % 3]).tolist()) for i in range(240)]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA).repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, neighbours=10, probe=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    own = {i: np.array(v) for i, v in rows}
    want = {i: sorted((j for j in own if j != i and len(own[j]) == len(own[i])), key=lambda j: (-float(own[i] @ own[j]), j))[:10] for i in range(0, 240, 20)}
    assert got == want


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = defaultdict(set)
    for r in ann.search_embeddings(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert np.mean([len(got[i] & set(np.argsort(-s[i])[:20].tolist())) / 20 for i in range(0, 3000, 20)]) >= 0.9


def recall(spark, df, ids, x):
    got = defaultdict(set)
    for r in ann.search_embeddings(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    found = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[ids == ids[k]] = -np.inf
        found.append(len(got[ids[k]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    return np.mean(found)


@pytest.mark.parametrize("width", [128, 256])
def test_search_recall_on_wide_vectors(spark, width):
    x = np.random.default_rng(2).normal(size=(4000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], SCHEMA).repartition(4)
    assert recall(spark, df, np.arange(4000), x) >= 0.92


def test_search_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    assert recall(spark, df, np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)) >= 0.95


def test_walk_goes_by_summed_value():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=5), rng.normal(size=4)
    cells = ann.walk(a, b, np.ones(20, int), 20)
    value = [a[c // 4] + b[c % 4] for c in cells]
    assert value == sorted(value, reverse=True) and sorted(cells) == list(range(20))
    assert len(ann.walk(a, b, np.ones(20, int), 3)) == 3


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.choice([3, 20, 80, 200]))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(100, 260):
        w = list(base[rng.randint(0, 39) if i < 200 else 2])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
    return rows + [(300, None), (301, ""), (302, " \n"), (303, ""), (304, "one"), (305, "ONE"), (306, "w " * 3000), (307, "w " * 3001), (308, "w " * 5)]


def brute_idf(rows):
    """log((1 + s) n / (df + s n)) + 1 by slot, each word sequence that is more than HEAVY of all counted once."""
    sh = textdedup.Shingler()
    sets = [tuple(sh.words((t or "").encode()).tolist()) for _, t in rows]
    sets = [s for s in sets if s]
    once = set(s for s in sets if sets.count(s) > textdedup.HEAVY * len(sets))
    kept = [s for s in sets if s not in once] + list(once)
    df = np.zeros(textdedup.SLOTS)
    for s in kept:
        df[list({int(h) >> 44 for h in sh.hashes(np.array(s, np.uint64))})] += 1
    return np.log((1 + textdedup.SMOOTH) * len(kept) / (df + textdedup.SMOOTH * len(kept))) + 1


def brute_groups(rows, idf):
    sh = textdedup.Shingler(idf)
    sets = {i: dict(zip(a.tolist(), (b * c).tolist())) for i, t in rows for a, b, c in [sh.shingles(sh.words((t or "").encode()))] if len(a)}
    words = {i: tuple((t or "").lower().split()) for i, t in rows}
    links = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            u, v = sets[a], sets[b]
            least = sum(min(w, v[k]) for k, w in u.items() if k in v)
            if words[a] == words[b] or least / (sum(u.values()) + sum(v.values()) - least) >= 0.8:
                links.append((a, b))
    same = roots([i for i, _ in rows], [(a, b) for a, b in links if words[a] == words[b]])
    return same, roots([i for i, _ in rows], links)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts()], "doc_id long, text string, node string, hi int").repartition(3)


def test_text_dedup(docs):
    rows = docs.select("doc_id", F.xxhash64("text").alias("x"), "text")
    idf = textdedup.shingle_idf(rows, textdedup.first_pass(rows).cache())
    assert np.allclose(idf, brute_idf(texts()), rtol=1e-5)
    same, groups = brute_groups(texts(), idf)
    got = {r["doc_id"]: r for r in textdedup.near_duplicates(docs).collect()}
    assert {i: r["copy_id"] for i, r in got.items()} == same
    assert {i: r["class_id"] for i, r in got.items()} == groups
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())
    assert len(set(groups.values())) < len(groups) - 60
    kept = textdedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(groups.values())


def test_text_dedup_in_parts(docs, monkeypatch):
    whole = sorted(map(tuple, textdedup.near_duplicates(docs).collect()))
    for name, value in (("PART", 7), ("BUCKET_PART", 5), ("BATCH", 40)):
        monkeypatch.setattr(textdedup, name, value)
    assert sorted(map(tuple, textdedup.near_duplicates(docs).collect())) == whole


def test_text_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 0), (1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "A b  c d e f", 0)], "doc_id long, text string, kept int")
    got = sorted(map(repr, (tuple(r) for r in textdedup.near_duplicates(df).collect())))
    assert got == sorted(map(repr, [(None, None, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]))
    assert textdedup.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = [[f"{c}{k}" for k in range(60)] for c in "abcdefg"]
    text = [" ".join(w) for w in words]
    near = [" ".join([*w[:-1], "other"]) for w in words]
    rows = [
        (3, text[0]), (3, text[0]), (3, near[0]), (8, text[0]),  # a repeated id, its own near copy and another's copy
        (None, text[1]), (None, text[1]), (None, near[1]),  # no id at all
        (None, text[2]), (5, near[2]),  # an id goes before none
        (10, text[3]), (11, text[3]), (11, text[4]),  # only one of the two texts of 11 is a copy
        (20, text[5]), (20, text[6]), (21, near[5]), (22, near[6]),  # near copies of either text of 20
        (30, None), (30, None), (None, ""), (None, ""),  # without words
    ]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _n int").repartition(3)
    kept = textdedup.keep_one(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    group = lambda t: None if not t else t.split()[0]
    assert sorted(((i, group(t)) for i, t in got), key=repr) == sorted([(3, "a0"), (None, "b0"), (5, "c0"), (10, "d0"), (11, "e0"), (20, "f0"), (20, "g0"), (30, None), (30, None), (None, None), (None, None)], key=repr)


def test_similarity_products_equal_sums():
    sh = textdedup.Shingler(np.random.default_rng(0).random(textdedup.SLOTS).astype(np.float32) + 1)
    own = [sh.shingles(sh.words(t.encode())) for _, t in texts() if t and t.strip()][:60]
    got = textdedup.similarities(own, width=64)
    for x in range(0, 60, 7):
        for y in range(1, 60, 5):
            if x == y:
                continue
            u, v = (dict(zip(s[0].tolist(), (s[1] * s[2]).tolist())) for s in (own[x], own[y]))
            least = sum(min(w, v[k]) for k, w in u.items() if k in v)
            assert got[x, y] == pytest.approx(least / (sum(u.values()) + sum(v.values()) - least), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("size, times", [(400, 60), (50_000, 12)])
def test_samples_estimate_similarity(size, times):
    rng = np.random.default_rng(5)
    sampler, agree, true = textdedup.Sampler(), [], []
    for share in (0.3, 0.6, 0.9):
        for _ in range(times):
            ids = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
            w = rng.uniform(0.5, 5, size)
            n = int(size * share)
            other = np.concatenate([ids[:n], rng.integers(0, 1 << 63, size - n, np.uint64)])
            agree.append((sampler.samples(ids, w) == sampler.samples(other, w)).mean())
            true.append(w[:n].sum() / (w.sum() + w[n:].sum()))
    assert np.abs(np.reshape(agree, (3, -1)).mean(1) - np.reshape(true, (3, -1)).mean(1)).max() < (0.03 if times > 20 else 0.06)


def edited(rng, base, rate):
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < rate else w for w in base)


def test_recall_by_edit_rate(spark):
    """Of the pairs (original, edited copy) that are 0.8 alike by brute force, how many share a group; prints the share that is 0.8 alike too."""
    rng, vocabulary = random.Random(11), [f"w{k}" for k in range(3000)]
    rows, pairs = [], defaultdict(list)
    for k in range(240):
        base = rng.choices(vocabulary, k=rng.choice([60, 200, 600]))
        rate = (0.005, 0.01, 0.02, 0.03)[k % 4]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, rate))]
        pairs[rate].append(2 * k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in textdedup.near_duplicates(df).collect()}
    _, want = brute_groups(rows, brute_idf(rows))
    for rate, firsts in pairs.items():
        alike = [i for i in firsts if want[i] == want[i + 1]]
        print(rate, len(alike) / len(firsts), sum(got[i] == got[i + 1] for i in alike) / max(1, len(alike)))
        assert sum(got[i] == got[i + 1] for i in alike) >= 0.95 * len(alike)
    assert all(got[i] == want[i] or got[i] == i for i in got)


def test_long_texts_are_parted_by_bytes(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(6000)]
    rows = [(i, " ".join([*base[: 100 * i], f"own{i}", *base[100 * i :]])) for i in range(8)] + [(100, "x" * 300_000), (101, "x" * 300_000 + " y")]
    monkeypatch.setattr(textdedup, "PART_BYTES", 40_000)
    got = {r["doc_id"]: r["class_id"] for r in textdedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {**{i: 0 for i in range(8)}, 100: 100, 101: 101}


def test_a_repeated_id_is_judged_by_its_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(20, a), (20, b), (21, a + " z"), (22, b + " z"), (5, "c d e f g h")]
    got = sorted(tuple(r) for r in textdedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5, 5, True), (20, 20, 20, True), (20, 20, 20, True), (21, 20, 21, False), (22, 20, 22, False)]
