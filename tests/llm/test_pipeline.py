from collections import defaultdict

import tiktoken

import corpus_pipeline
from sievelake.llm import bpe, common, mixing, registry, textdedup


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *registry.queries()} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    sizes, frames = [docs.count()], [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(common.written(stage(spark, frames[-1], sf_dir), "stage"))
        sizes.append(frames[-1].count())
        if k < 4:
            assert frames[-1].columns == docs.columns
    original = {r["doc_id"]: r for r in docs.collect()}
    for f in frames[1:5]:
        assert all(r == original[r["doc_id"]] for r in f.collect())
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    good = {r["doc_id"] for r in frames[1].collect()}
    known = [i for i in labels if i in original]
    assert sum((i in good) == bool(labels[i]) for i in known) / len(known) > 0.9
    # near-duplicates: one of each group that the operator finds, which is tested against brute force
    groups = {r["doc_id"]: r["class_id"] for r in textdedup.near_duplicates(frames[2]).collect()}
    assert {r["doc_id"] for r in frames[3].collect()} == set(groups.values())
    words, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in frames[3].collect():
        words[r["source"]] += len(r["text"].split())
        most[r["source"]] = max(most[r["source"]], len(r["text"].split()))
    for r in frames[4].collect():
        taken[r["source"]] += len(r["text"].split())
    target = {r["source"]: r["target"] for r in mixing.mix_documents(frames[3]).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in words)
    path, pattern = bpe.default_vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in frames[5].limit(50).collect():
        assert r["ids"] == public.encode_ordinary(original[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
    assert sizes[5] == sizes[4]


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and got.count() > 0
