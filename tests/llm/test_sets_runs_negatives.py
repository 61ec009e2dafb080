"""Odd-sketch near-duplicates, periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwatch.llm import negatives, oddsketch, periodic, queries
from tests.llm.conftest import BASE, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near-duplicates by odd sketches


def brute_set(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(docs, percent=85):
    """docs: (doc_id, text); (n, component) of each, an empty set on its own."""
    sets = [brute_set(t) for _, t in docs]
    parent = {s: s for s in sets if s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent, key=len)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(b)] = root(a)
    least = {}
    for (d, _), s in zip(docs, sets):
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return [(len(s), least.get(root(s)) if s else d) for (d, _), s in zip(docs, sets)]


def changed(words, n, rng):
    """The words with n of them replaced by ones that occur nowhere else."""
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.getrandbits(40)}"
    return words


def test_near_duplicates_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, c, d == c) for (d, _), (n, c) in zip(docs, brute_components(docs))}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op12_odd_sketches(spark, sf_dir).collect()}
    assert got == want
    assert any(not kept for _, _, kept in want.values())


@pytest.mark.parametrize("bucket_rows,group_shingles", [(50_000, 2_000_000), (4, 500)])
def test_planted_families_match_brute_force(spark, make_docs, bucket_rows, group_shingles):
    """Copies at every distance around the threshold, chains, templated texts; whole buckets and groups, or ones in parts."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 400))]
        texts.append(base)
        for _ in range(6):
            texts.append(changed(base, rng.randint(0, max(1, len(base) // 40)), rng))
        chain = base
        for _ in range(4):
            chain = changed(chain, max(1, len(base) // 90), rng)
            texts.append(chain)
    form = [f"t{i}" for i in range(120)]
    texts += [changed(form, rng.randint(3, 6), rng) for _ in range(60)]
    texts += [["one"], ["one", "two"], ["one", "two"], [], ["One"]]
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_components(docs)
    found = oddsketch.similar_sets(make_docs(rows(*[t for _, t in docs])), bucket_rows=bucket_rows, group_shingles=group_shingles)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == {d: w for (d, _), w in zip(docs, want)}


def test_bands_and_sketches_miss_next_to_nothing_at_the_threshold():
    rng = np.random.default_rng(3)
    most, missed, total = oddsketch.most_differing(85), 0, 400
    for size in (20, 100, 1000, 5000):
        for _ in range(total // 4):
            union = rng.integers(0, 1 << 63, size * 100 // 85 // 2 * 2, dtype=np.int64).astype(np.uint64)
            only = (len(union) - -(-85 * len(union) // 100)) // 2
            a, b = np.sort(union[only:]), np.sort(union[: len(union) - only])
            values = oddsketch.samples(np.array([0, len(a), len(a) + len(b)]), np.r_[a, b])
            keys, (x, y) = oddsketch.band_keys(values), oddsketch.odd_sketches(values)
            missed += not (keys[:, 0] == keys[:, 1]).any() or int(np.bitwise_count(x ^ y).sum()) > most
    assert missed == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(4)
    for share in (0.8, 0.9, 0.97):
        off = []
        for _ in range(60):
            union = rng.integers(0, 1 << 63, 2000, dtype=np.int64).astype(np.uint64)
            only = round(2000 * (1 - share) / 2)
            a, b = union[only:], union[: 2000 - only]
            x, y = oddsketch.odd_sketches(oddsketch.samples(np.array([0, len(a), len(a) + len(b)]), np.r_[a, b]))
            off.append(oddsketch.similarity(int(np.bitwise_count(x ^ y).sum())) - share)
        assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = oddsketch.similar_sets(odd).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, ((d, n, c) for (d, _), (n, c) in zip(docs, brute_components(docs)))))
    assert oddsketch.similar_sets(none).collect() == []


# --- periodic runs


def brute_runs(w, least=6, periods=4):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            part = w[i : j + q]
            if length >= max(least, periods * q) and not any(part[p:] == part[: length - p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters = rng.randint(0, 150), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            s, p, more = rng.randrange(n + 1), rng.randint(1, 30), rng.randint(4, 120)
            for i in range(s + p, min(n, s + more)):
                w[i] = w[i - p]
        assert periodic.runs(np.array(w, np.int64)) == brute_runs(w)


def test_runs_of_long_texts_are_found_at_every_scale():
    for period in (1, 2, 3, 7, 8, 100, 1023, 1024, 1025, 9999):
        w = np.r_[np.arange(10**6, 10**6 + 77), np.tile(np.arange(period), 5)[: 4 * period + 2], np.arange(2 * 10**6, 2 * 10**6 + 9)]
        assert periodic.runs(w) == ([(77, 4 * period + 2 if period > 1 else 5, period)] if period > 1 else [])
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), periods=3)


def test_runs_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [d for d in docs if len(WORD.findall(d[1] or "")) <= 1500]
    assert len(short) > 150
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, text in short:
        assert got[d] == brute_row(d, text)
    assert sum(r[1] > 0 for r in got.values()) >= 5


def test_runs_of_odd_rows(spark, odd, none):
    got = periodic.periodic_runs(odd).collect()
    want = []
    for r in odd.collect():
        w = WORD.findall(r.text or "")
        found = [(0, len(w), 1)] if len(w) == 30_000 else brute_runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r.doc_id, len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(str, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got))) == sorted(map(str, want))
    assert periodic.periodic_runs(none).collect() == []
    assert queries.with_periodic_tails(odd.select("doc_id", "text")).count() == odd.count()
    long = spark.createDataFrame([(d, f"{'a b c d e f g ' * 9}") for d in range(60)], "doc_id long, text string")
    assert [tuple(r) for r in queries.with_periodic_tails(long).collect()] != [tuple(r) for r in long.collect()]


# --- hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("uid", T.StringType())])


def brute_negatives(data, positives=5, negatives_=3, low=50, high=95):
    live = []
    for vec_id, x, label, *_ in data:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        live.append((vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (anchor, label, a) in enumerate(live):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(p * q for p, q in zip(a, b)), vec_id, other) for j, (vec_id, other, b) in enumerate(live) if j != i]
        for p, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = sorted((s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p), key=order)[:negatives_]
            out += [(anchor, positive, k + 1, n, p, s) for k, (s, n, _) in enumerate(fit)]
    return sorted(map(str, out))


def mined(df):
    rows_ = negatives.hard_negatives(df, anchor=F.col("vec_id") % 50 == 0, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(str(tuple(r)) for r in rows_.collect())


def test_hard_negatives_of_odd_rows_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, (rng.standard_normal(6) * rng.choice([0.1, 1, 30])).astype(np.float32).tolist(), int(rng.integers(3)), "s", "u") for i in range(160)]
    data += [(200, data[0][1], None, None, None), (250, None, 1, None, None), (300, [float("nan")] * 6, 1, None, None), (350, [float("inf")] * 6, 1, None, None), (400, [None] * 6, 1, None, None)]
    data += [(None, data[3][1], 1, None, None), data[50], data[50], (450, [], 1, None, None), (500, [0.5, 0.5], 2, None, None), (501, data[7][1], 0, None, None), (502, data[7][1], 0, None, None)]
    want = brute_negatives(data)
    assert len(want) > 20 and mined(spark.createDataFrame(data, VECTORS)) == want
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert mined(spark.createDataFrame(data, VECTORS)) == want
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_sliced_products_leave_exact_scores():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-256, 256, (20, 64)), rng.integers(-256, 256, (300, 64))
    everything = np.ones((20, 300), bool)
    i, j, s = negatives.sliced(a, b, everything, lambda lo, hi, alive: alive)
    assert len(s) == 6000 and (s == (a @ b.T)[i, j]).all()
    asked = []

    def rule(lo, hi, alive):
        assert ((lo <= a @ b.T) & (a @ b.T <= hi))[alive].all()
        asked.append(int(alive.sum()))
        return negatives.best_rule(3)(lo, hi, alive)

    i, j, s = negatives.sliced(a, b, everything, rule)
    for x in range(20):
        want = np.sort((a @ b.T)[x])[-3:]
        assert set(want.tolist()) <= set(s[i == x].tolist())
    assert asked[-1] < asked[0] / 20  # later planes look at few pairs


def test_components_beyond_the_bound_are_held(spark):
    df = spark.createDataFrame([([3.0e38, -3.0e38, 0.999, -0.001],)], "v array<float>")
    assert df.select(negatives.quantised(F.col("v"))).head()[0] == [(1 << 24) - 1, -(1 << 24), 255, -1]
