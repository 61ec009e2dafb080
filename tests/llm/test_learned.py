"""Toxicity and the pipeline: held-out quality, odd rows, and each stage against a brute-force version."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cairnwatch.llm import queries, toxicity
from tests.llm.test_near_and_leaks import brute_hits, brute_similar


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    labels = np.asarray(labels)
    p, n = labels.sum(), (1 - labels).sum()
    return (rank[labels == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_toxicity_held_out(spark):
    import zlib

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert auc([h[0] for h in held], [h[1] for h in held]) > 0.93
    toxic = [h for h in held if h[1]]
    clean = [h for h in held if not h[1]]
    assert sum(h[2] for h in toxic) > 0.85 * len(toxic) and sum(h[2] for h in clean) < 0.04 * len(clean)


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    texts += [t + " numbskull " + t for t in texts[:40]]
    model = toxicity.fit(texts, [0] * 200 + [1] * 40)
    score = lambda texts: toxicity.score(model, texts)
    plain, spelled, right = score([texts[0], texts[0] + " numbskul", texts[0] + " numbskull"])
    assert right >= spelled > 0.3 > plain


def test_length_alone_is_not_toxic():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    model = toxicity.fit(texts + [t + " numbskull " + t for t in texts[:40]], [0] * 200 + [1] * 40)
    long = " ".join(rng.choice(words, 150_000))
    blank = "qqqq " * 2_000_000
    clean, found, filler = toxicity.score(model, [long, long + " numbskull " + long, blank])
    assert clean < 0.3 <= found and filler < 0.3


def test_toxicity_without_labels_and_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(r.score < 0.3 for r in got)
    assert toxicity.scored(none, model).count() == 0
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    some = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (3, 1, None), (None, 0, 1), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, toxicity.train(odd, some)).count() == odd.count()


def test_pipeline_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    def step(name, docs):
        from cairnwatch.llm.common import cut

        return cut(stages[name](spark, docs, sf_dir), "test")

    clean = step("toxicity", docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).where("score >= 0.3").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    single = step("near_duplicates", clean)
    want = {c for c in brute_similar([(r.doc_id, r.text) for r in clean.collect()]).values()}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)
    safe = step("decontamination", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in single.collect()], items)
    assert safe.columns == columns and {r.doc_id for r in safe.collect()} == {d for d, h in hits.items() if not h[4]}
    mixed = step("mixing", safe)
    assert mixed.columns == columns and set(mixed.collect()) <= set(safe.collect())
    assert max(Counter(mixed.collect()).values()) <= 3
    shards = step("sharding", mixed)
    counts = Counter(r.shard for r in shards.collect())
    assert sum(counts.values()) == mixed.count() and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_run(spark, sf_dir):
    """run() gives a row for each copy in the mix, and leaves behind only the table that it reads."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    got = corpus_pipeline.run(spark, sf_dir)
    rows = got.collect()
    left = [p.name for p in set(shared.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("pipeline-sharding"), left
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot"] and len(rows) > 50
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r.text_crc32, set()).add(r.doc_id)
    assert all(len(ids) == 1 for ids in texts.values())  # one document of each group of copies


def test_pipeline_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.collect()


@pytest.mark.parametrize("text", ["", None, "word"])
def test_fit_needs_both_labels(text):
    assert toxicity.score(toxicity.fit([text], [1]), [text])[0] > 0.9
    assert toxicity.score(toxicity.fit([], []), [text])[0] < 0.1


def test_sample_is_bounded(spark, monkeypatch):
    """Repeated ids count once, and texts beyond the bound on bytes are left out."""
    docs = [(i, ("vile scum " if i % 2 else "kind words ") * 20 + str(i)) for i in range(1, 41)] + [(3, "again"), (3, "again"), (7, "x" * 5000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, weights: seen.append((texts, toxic)) or toxicity.Model(np.zeros(4), 0.0))
    toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    texts, toxic = seen[0]
    assert set(toxic) == {0, 1} and all(0 < sum(len(t) for t, y in zip(texts, toxic) if y == k) <= 2000 for k in (0, 1))
