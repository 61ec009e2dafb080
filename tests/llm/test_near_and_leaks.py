"""SimHash, decontamination, mixing and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnwatch.llm import decontaminate, mixing, queries, sharding, simhash
from cairnwatch.llm.common import connected_components
from tests.llm.conftest import rows


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    """fps: list of (doc_id, fp); smallest doc_id reachable for each."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in fps}


def test_simhash_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", want[d, f]) for d, f in fps}


def test_links_in_split_blocks_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for n in (1, 2, 3, 4, 5):
            x = f
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.append(x)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(20, 40)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 4, block_variants=20_000)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    want = brute_components([(i, f) for i, f in enumerate(sorted(set(fps)))])
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    groups = defaultdict(set)
    for (_, f), c in want.items():
        groups[c].add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(f for f in set(fps) if root(f) == r) for r in {root(f) for f in fps}}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[2] == {1} and by[1] == {1} and by[77] == by[4] == by[3] == {3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] >= 1 and ids[2] == 0 and ids[77] == 0 and ids[4] == 0 and ids[3] == 1
    assert simhash.keep_one(none).count() == 0


def brute_similar(docs, k=5, least=0.8):
    """Smallest doc_id of each document's group of similar texts, all pairs compared."""
    sets = {}
    for d, t in docs:
        words = (t or "").lower().split()
        sets[d] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    label = {d: d for d, _ in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(label)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= least * len(x | y) > 0:
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: root(d) for d in ids}


def test_similar_groups_find_near_copies(make_docs):
    import random

    from tests.llm.conftest import rows

    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(30, 400))
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.015):
            changed = list(base)
            for i in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                changed[i] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    texts += [texts[0], "", "  ", "short text"]
    want = brute_similar(list(enumerate(texts)))
    found = simhash.similar_groups(make_docs(rows(*texts)), part_variants=50_000).collect()
    least = {}
    for r in found:
        least[r.label] = min(r.doc_id, least.get(r.label, r.doc_id))
    got = {r.doc_id: least[r.label] for r in found}
    assert len(got) == len(texts)
    assert sum(got[d] != want[d] for d in want) <= 2  # a pair at the threshold may not meet
    assert all(want[got[d]] == want[d] for d in want)  # and nothing else is linked

def test_similar_groups_find_the_base_of_a_star_family(make_docs):
    import random

    from tests.llm.conftest import rows

    rng = random.Random(5)
    base = ["b%d" % i for i in range(204)]
    texts = []
    for n in range(3000):
        changed = list(base)
        for i in rng.sample(range(2, 202, 5), 3):  # three edits apart: 0.86 to the base, about 0.75 to each other
            changed[i] = f"e{n}x{i}"
        texts.append(" ".join(changed))
    texts.insert(1500, " ".join(base))
    found = simhash.similar_groups(make_docs(rows(*texts))).collect()
    sizes = Counter(r.label for r in found)
    assert len(found) == 3001 and max(sizes.values()) >= 2980  # a pair may not meet in any band


@pytest.mark.parametrize("seed", [1, 2])
def test_a_blocks_forest_joins_what_its_colliding_pairs_join(seed):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 256)
    bits = np.array([base ^ (rng.random(256) < 0.08) for _ in range(120)]).astype(np.uint8)
    four = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    fps = simhash.band(four.view(np.uint64), 3)
    group, owner, _ = simhash.collisions(fps, np.zeros(120, np.int64), simhash.BAND_BITS, 2)
    want = set()
    for g in np.unique(group):
        own = sorted(set(owner[group == g].tolist()))
        want |= {(b, a) for i, a in enumerate(own) for b in own[i + 1 :] if np.bitwise_count(four[a].view(np.uint64) ^ four[b].view(np.uint64)).sum() <= simhash.MOST_DIFFERING}

    def components(pairs, label):
        for _ in range(120):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    for labels_ in (list(range(120)), [i % 7 for i in range(120)]):
        apart = {(a, b) for a, b in want if labels_[a] != labels_[b]}
        pdf = pd.DataFrame({"id": np.arange(120), "label": labels_} | {w: four[:, j] for j, w in enumerate(simhash.WORDS)})
        out = simhash._block_forest(0, 20_000)((pa.scalar(3), pa.scalar(0)), pa.Table.from_pandas(pdf)).to_pandas()
        made = {(max(a, b), min(a, b)) for a, b in zip(out["a"], out["b"])}
        assert made <= apart and len(made) == len(out) and len(apart) > 400
        assert components(made, list(range(120))) == components(apart, list(range(120)))


def test_chunks_leave_no_near_pair_out():
    """Bands within the radius agree in the chosen chunks of some way, however many must agree."""
    rng = np.random.default_rng(2)
    for agree in range(5):
        ways = simhash.chunked(agree)
        assert all(sum(n for _, n in own + rest) == simhash.BAND_BITS for own, rest in ways)
        for _ in range(300):
            x = int(rng.integers(0, 1 << simhash.BAND_BITS))
            y = x ^ sum(1 << int(b) for b in rng.choice(simhash.BAND_BITS, simhash.BAND_RADIUS, replace=False))
            two = np.array([x, y], np.uint64)
            assert any(len(set(simhash._bits_of(two, own)[0].tolist())) == 1 for own, _ in ways)
    assert [simhash._agreeing(n, 1000) for n in (1000, 1001, 10**5, 10**6, 10**9)] == [0, 1, 1, 2, 4]


def test_components_of_any_graph(spark):
    """Chains, cycles, stars and loops against union-find."""
    import random

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(i, 300) for i in range(301, 340)] + [(400, 400)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)] + [(-5, 7), (7, -9)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(x, root(x)) for x in label} and len(got) == len(label)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited_families(rng, families, shares, words=150):
    """Texts in families of one base, with so many shares of their words changed."""
    vocabulary = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=words)
        texts.append(" ".join(base))
        for share in shares:
            changed = list(base)
            for i in rng.sample(range(words), max(1, int(share * words))):
                changed[i] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    return texts


def labels(found):
    least = {}
    for r in found:
        least[r.label] = min(r.doc_id, least.get(r.label, r.doc_id))
    return {r.doc_id: least[r.label] for r in found}


def test_split_blocks_give_the_same_groups(make_docs):
    """Blocks by chunk, and crowded ones in parts, change where fingerprints meet, not which."""
    import random

    texts = edited_families(random.Random(3), 12, [0.007] * 9 + [0.02] * 3)
    docs = make_docs(rows(*texts, "", None))
    want = labels(simhash.similar_groups(docs).collect())
    assert labels(simhash.similar_groups(docs, block_rows=20).collect()) == want
    # A whole group finds similar texts that share no variant too; in parts only colliding ones are sure.
    parts = labels(simhash.similar_groups(docs, group_shingles=400).collect())
    assert all(want[parts[d]] == want[d] for d in want) and sum(parts[d] != want[d] for d in want) <= 3


def test_templated_texts_cost_no_pairs(make_docs):
    """Texts that collide without being similar: no group, and no more edges than texts a block."""
    import random

    rng = random.Random(9)
    form = ["t%d" % i for i in range(120)]
    texts = []
    for n in range(400):
        changed = list(form)
        for i in rng.sample(range(120), 7):
            changed[i] = f"v{n}x{i}"
        texts.append(" ".join(changed))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i in range(400) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for small in (simhash.GROUP_SHINGLES, 5000):
        found = labels(simhash.similar_groups(make_docs(rows(*texts)), group_shingles=small).collect())
        assert sum(found[d] != d for d in found) == len({i for i, _ in alike})


def test_keep_one_takes_maps_and_moves_repeated_rows_alone(spark):
    data = [(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"y": 2}), (2, "p q r s t u", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, props map<string,int>")
    kept = [sorted(map(str, simhash.keep_one(d).collect())) for d in (docs, docs.orderBy(F.desc("doc_id")))]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_recall_by_similarity(make_docs):
    """Of the pairs that are alike, nine of ten and more end in one group, in each bin of similarity; none below does."""
    import random

    texts = edited_families(random.Random(8), 150, [0.0201, 0.0201, 0.0134])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    found = labels(simhash.similar_groups(make_docs(rows(*texts))).collect())
    bins = defaultdict(list)
    for k in range(0, len(texts), 4):
        for i in range(k, k + 4):
            for j in range(i + 1, k + 4):
                like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if like >= 0.8:
                    bins["0.80" if like < 0.85 else "0.85" if like < 0.9 else "0.90"].append(found[i] == found[j])
    assert set(bins) >= {"0.80", "0.85"}, {b: len(x) for b, x in bins.items()}
    assert all(sum(x) >= 0.9 * len(x) for x in bins.values()), {b: (sum(x), len(x)) for b, x in bins.items()}
    want = brute_similar(list(enumerate(texts)))
    assert all(want[found[d]] == want[d] for d in want)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_links_of_any_radius_equal_all_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for c in centres for _ in range(8)], np.uint64))
    made = simhash.meetings(fps, np.zeros(len(fps), np.int64), 64, radius) if radius < 5 else simhash.meetings(fps, np.zeros(len(fps), np.int64), 64, 5)
    assert all(int(fps[a] ^ fps[b]).bit_count() <= radius for a, b in made)

    def components(pairs):
        label = list(range(len(fps)))
        for _ in range(len(fps)):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius]
    assert components(made) == components(every)


def test_rows_that_tie_and_columns_that_clash(spark):
    """Any column name passes through; of rows equal in id and text the same one stays, however they lie."""
    data = [(1, "a b c d e f", "x", "s", 3), (1, "a b c d e f", "y", "s", 4), (2, "p q r s t u", "z", None, 5)]
    names = "doc_id long, text string, _row_key string, source string, key int"
    kept = [simhash.keep_one(spark.createDataFrame(d, names)).collect() for d in (data, data[::-1])]
    assert sorted(kept[0]) == sorted(kept[1]) and len(kept[0]) == 2 and set(kept[0][0].asDict()) == {"doc_id", "text", "_row_key", "source", "key"}
    items = spark.createDataFrame([(9, "p q r s t u")], "item_id long, text string")
    left = decontaminate.clean(spark.createDataFrame(data, names), items).collect()
    assert sorted(r["_row_key"] for r in left) == ["x", "y"]
    copies = mixing.mixed(spark.createDataFrame(data, names.replace("_row_key", "_source_key"))).collect()
    assert {r["_source_key"] for r in copies} <= {"x", "y", "z"} and copies


def brute_hits(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - window + 1)) if ws else ():
            windows[tuple(ws[k : k + window])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(ws), len(hit), len(found), digest, bool(hit))
    return out


def test_decontamination_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontamination(spark, sf_dir).collect()}
    want = brute_hits(docs, items)
    assert got == want
    assert any(w[4] for w in want.values())


def test_decontamination_odd_rows_and_blocks(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "Quick BROWN fox"), (2, None), (None, "lazy dog"), (3, ""), (4, "word " * 12), (4, "seven wise owls watch")], "item_id long, text string")
    one = sorted((r.doc_id is None, r.doc_id, r.n_words, str(r.spans), r["items"]) for r in decontaminate.matches(odd, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    many = sorted((r.doc_id is None, r.doc_id, r.n_words, str(r.spans), r["items"]) for r in decontaminate.matches(odd, items).collect())
    assert one == many and len(one) == odd.count()
    assert {r[1] for r in one if r[4]} == {1, 2, 6, 7}
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(odd, items.where("false")).where("size(spans) > 0").count() == 0
    clean = decontaminate.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 5


def test_proximity(spark, make_docs):
    from tests.llm.conftest import rows

    docs = make_docs(rows("alpha x x beta x gamma", "alpha " + "x " * 40 + "beta gamma"))
    items = spark.createDataFrame([(5, "gamma alpha beta")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.matches(docs, items, near_span=8).collect()}
    assert got == {0: ([], [5]), 1: ([], [])}


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def test_mixing_meets_targets(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken = brute_targets(sizes), Counter()
    got = queries.op9_entropy_balancing(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        source = docs[r.doc_id].source
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source] and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 50), s
    again = queries.op9_entropy_balancing(spark, sf_dir).collect()
    assert sorted(got) == sorted(again)


def test_mixing_odd_rows(odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == odd.count()
    assert all(r.copies <= 3 for r in got)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0


def test_rounding_closes_the_gap_in_groups_of_any_size():
    """The words left over are as few as any one or two moves make them, by brute force."""
    for n, seed in ((5, 1), (60, 2), (700, 3)):
        rng = np.random.default_rng(seed)
        words, copies = rng.integers(1, 3000, n), rng.integers(0, 4, n)
        left = float(rng.integers(-4000, 4000)) + 0.25
        closed = mixing._closed(words.copy(), copies.copy(), left, 3)
        gap = left - ((closed - copies) * words).sum()
        assert closed.min() >= 0 and closed.max() <= 3 and abs(gap) <= abs(left)
        moves = np.concatenate([np.where(closed < 3, words, 0), np.where(closed > 0, -words, 0)])
        pairs = moves[:, None] + moves[None, :]
        same = np.arange(2 * n)[:, None] % n == np.arange(2 * n)[None, :] % n
        least = min(np.abs(gap - moves).min(), np.abs(gap - pairs[~same]).min())
        assert abs(gap) <= least + 1e-5, (n, gap, least)


def test_small_source_is_capped(make_docs):
    from tests.llm.conftest import rows

    docs = make_docs(rows(*["w " * 100] * 30, source="a") + rows("one two three", start=50, source="b"))
    got = {r.source_key: r for r in mixing.plan(docs).collect()}
    assert got["=b"].target == 9 and got["=b"].copies == 3
    assert got["=a"].target == pytest.approx(3003 - 9)


def test_sharding_law_and_groups(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op6_label_propagation(spark, sf_dir).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(docs) and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    shards = defaultdict(list)
    for r in got:
        shards[docs[r.doc_id]].append(r.shard)
    together = sum(len(set(s)) == 1 for s in shards.values() if len(s) > 1)
    assert together >= 0.9 * sum(len(s) > 1 for s in shards.values())


def test_sharding_splits_an_oversized_group(make_docs):
    from tests.llm.conftest import rows

    docs = make_docs(rows(*["same"] * 300, *[f"t{i}" for i in range(100)], *["pair", "pair"] * 20))
    got = sharding.assign(docs, shards=8).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(got) == 440


def test_sharding_splits_no_more_than_it_must(make_docs):
    from tests.llm.conftest import rows

    sizes = {"most": 45, "some": 15, "hot": 133, "other": 30}  # a shard has 50 rows
    docs = make_docs(rows(*[t for t, n in sizes.items() for _ in range(n)], *[f"t{i}" for i in range(177)]))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.assign(docs, shards=8).collect()
    assert set(Counter(r.shard for r in got).values()) == {50}
    where = {t: {r.shard for r in got if text[r.doc_id] == t} for t in sizes}
    assert {t: len(s) for t, s in where.items()} == {"most": 1, "some": 1, "hot": 3, "other": 1}


def test_sharding_lays_small_groups_out_when_all_rows_are_linked(make_docs):
    from tests.llm.conftest import rows

    docs = make_docs(rows(*[f"t{i}" for i in range(100) for _ in range(3)]))
    got = sharding.assign(docs, shards=7).collect()  # shards of 42 and 43 rows, groups of 3
    assert set(Counter(r.shard for r in got).values()) == {42, 43} and len({r.doc_id for r in got}) == 300
    assert len({(r.doc_id // 3, r.shard) for r in got}) <= 100 + 7


def pairs_cut(where, hubs):
    """Brute force: pairs of rows that share a hub but not a shard, for each hub."""
    return sum(where[a] != where[b] for members in hubs.values() for i, a in enumerate(members) for b in members[:i])


def test_propagation_lowers_the_cut_of_any_graph(spark, make_docs):
    """Ten communities whose rows have several hubs each, with some links between communities."""
    import random

    rng = random.Random(2)
    hubs = defaultdict(set)
    for d in range(240):
        for h in range(3):
            hubs[f"{d // 24}-{rng.randrange(4)}"].add(d)
        if d % 9 == 0:
            hubs[f"x{d // 18}"].update((d, rng.randrange(240)))
    docs = make_docs(rows(*[f"text {i}" for i in range(300)]))
    links = spark.createDataFrame([(d, h) for h, ds in hubs.items() for d in ds] + [(1, None), (999, "gone")], "doc_id long, hub string")
    got = sharding.assign_links(docs, links, shards=5).collect()
    where = {r.doc_id: r.shard for r in got}
    assert len(got) == 300 and set(Counter(where.values()).values()) == {60}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(60)) for s in range(5))
    state = spark.createDataFrame(list(where.items()), "uid long, shard int")
    edges = spark.createDataFrame([(d, i) for i, ds in enumerate(hubs.values()) for d in ds], "uid long, hub long")
    after = pairs_cut(where, {h: sorted(ds) for h, ds in hubs.items()})
    assert sharding.cut_links(state, edges) == after
    every = sum(len(ds) * (len(ds) - 1) // 2 for ds in hubs.values())
    assert after < 0.6 * every * 0.8  # random shards cut four fifths


def test_groups_that_need_no_cut_get_none(spark, make_docs):
    """Twenty cliques of ten over four shards of fifty, their rows dealt at random: the optimum cuts nothing."""
    import random
    import time

    order = list(range(200))
    random.Random(4).shuffle(order)
    docs = make_docs(rows(*[f"text {i}" for i in range(200)]))
    links = spark.createDataFrame([(d, f"h{i // 10}") for i, d in enumerate(order)], "doc_id long, hub string")
    began = time.time()
    where = {r.doc_id: r.shard for r in sharding.assign_links(docs, links, shards=4).collect()}
    assert time.time() - began < 60 and set(Counter(where.values()).values()) == {50}
    assert all(len({where[d] for d in order[k : k + 10]}) == 1 for k in range(0, 200, 10))


def test_requests_are_granted_without_changing_counts():
    free = [3, 0, 1]
    granted, returned = sharding.admitted({(0, 1): 5, (1, 0): 2, (2, 0): 4, (1, 2): 7}, free)
    net = Counter()
    for moves in (granted, returned):
        for (i, j), n in moves.items():
            net[i] -= n
            net[j] += n
    assert not any(net.values()) and granted == {(0, 1): 2, (1, 0): 2, (2, 0): 3, (1, 2): 1} and free == [0, 0, 0]


def test_sharding_odd_rows(odd, none):
    got = sharding.assign(odd, shards=4).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.assign(none).count() == 0
    assert sharding.assign_links(odd, odd.selectExpr("doc_id", "source AS hub"), shards=4).count() == odd.count()
