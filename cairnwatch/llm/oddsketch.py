"""Near-duplicates by MinHash bands and odd sketches.

A text is the set of its word shingles. SAMPLES MinHash values of the set are cut into bands
of a few values, and sets that share a band are candidates. All samples are also folded into
an odd sketch, a bitmap in which each sample flips one bit; the XOR of two sketches holds the
parity of the samples in which they differ, so that its population count estimates a high
similarity closely. Candidates whose sketches differ too much are dropped without their
texts; the others are confirmed on their full sets.

No bucket lists its pairs. A first round compares each text with one member of its buckets,
that with the nearest sketch, so that a group of copies of any size becomes one component in
linear work. Only buckets that then hold several components are looked at further: a spanning
forest of the pairs near by sketch says which texts may link them, and these are confirmed
where they meet, by a search from text to text that passes over what it has reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import connected_components, cut, id_text, mix, row_key, slices, tidy
from cairnwatch.llm.groups import by_group, confirmed, many, meeting, numbers, searched, shingle_sets, starred, texts_of

#: MinHash samples, bands of so many of them, and bits of an odd sketch.
SAMPLES, BANDS, PER_BAND, SKETCH_BITS = 256, 24, 5, 512
#: Standard deviations that a pair at the threshold may lie off its expected sketch distance.
MARGIN = 5.5
#: Rows of a bucket and shingles of a group that one task compares at most; larger ones go in parts, each two of which meet.
BUCKET_ROWS, GROUP_SHINGLES = 50_000, 2_000_000
WORDS = [f"s{j}" for j in range(SKETCH_BITS // 64)]
_rng = np.random.default_rng(85)
_TIMES = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def samples(begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash values, a column for each set, a row for each sample; no set may be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(begins) - 1), np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat(x * _TIMES[i] + _PLUS[i], begins[:-1])
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Bitmaps of the columns of `values`, SKETCH_BITS bits as words of 64: each sample flips the bit that it hashes to."""
    bits = np.zeros((values.shape[1], SKETCH_BITS), np.uint8)
    all_ = np.arange(values.shape[1])
    for i in range(len(values)):
        to = mix(values[i].astype(np.uint64) ^ np.uint64((i + 1) << 32)) % np.uint64(SKETCH_BITS)
        bits[all_, to.astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A number for each band (row) of each set (column), the same where the band and its samples are."""
    keys = np.empty((BANDS, values.shape[1]), np.uint64)
    for b in range(BANDS):
        key = np.full(values.shape[1], b + 1, np.uint64)
        for i in range(b * PER_BAND, (b + 1) * PER_BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[i])
        keys[b] = key
    return keys


def similarity(differing: np.ndarray | float) -> np.ndarray | float:
    """The similarity estimated from how many bits of two odd sketches differ."""
    full = np.maximum(1 - 2 * np.asarray(differing, float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(full)


def most_differing(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ, MARGIN standard deviations included.

    A share 1 - J of the samples differs, binomially, and flips two bits each; d flips set
    (1 - (1 - 2 / n) ** d) n / 2 of n bits odd, with a variance of n / 4 (1 - (1 - 4 / n) ** d)
    around that at most.
    """
    j, n = percent / 100, SKETCH_BITS
    flips = 2 * (SAMPLES * (1 - j) + MARGIN * (SAMPLES * j * (1 - j)) ** 0.5)
    odd = n / 2 * (1 - (1 - 2 / n) ** flips)
    # Of the sketch's own spread only collisions count, about flips ** 2 / n of them.
    return int(np.ceil(odd + MARGIN * (flips**2 / n / 4) ** 0.5))


_SIGNED = f"doc_id long, key binary, n long, set_key binary, bands array<long>, {', '.join(f'{w} long' for w in WORDS)}"


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            begins, h = shingle_sets(part.column("text").to_pylist(), shingle)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            keys: list[bytes | None] = [None] * len(n)
            for i in some.tolist():
                keys[i] = hashlib.md5(h[begins[i] : begins[i + 1]].tobytes(), usedforsecurity=False).digest()
            bands, words = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), len(WORDS)), np.uint64)
            if len(some):
                values = samples(np.r_[begins[some], len(h)], h)
                bands[some], words[some] = band_keys(values).T, odd_sketches(values)
            signed = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, signed.__len__() + 1, BANDS, dtype=np.int32)), signed)
            columns = [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, *[pa.array(words[:, j].view(np.int64)) for j in range(len(WORDS))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "set_key", "bands", *WORDS])

    return run


def _near_forest(percent: int, most: int):
    """A spanning forest of the pairs of a bucket that lie in two components and are near by sketch and size."""

    def work(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, labels, n = (numbers(table, c) for c in ("id", "label", "n"))
        sketch = np.stack([numbers(table, w) for w in WORDS], 1).view(np.uint64)

        def reached(p: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[(labels[rest] != labels[p]) & (100 * np.minimum(n[rest], n[p]) >= percent * np.maximum(n[rest], n[p]))]
            return rest[np.bitwise_count(sketch[rest] ^ sketch[p]).sum(1) <= most]

        a, b = searched(len(ids), reached)
        return ids[a], ids[b]

    return work


@tidy
def similar_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, bucket_rows: int = BUCKET_ROWS, group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) for each row of docs.

    Rows link whose sets of word shingles hold 100 * intersection >= percent * union; equal
    sets always do. component_id is the smallest doc_id reachable. Words are divided by ASCII
    whitespace with A-Z lower-cased; a text with fewer words than a shingle is one shingle.
    Null texts and those without words have no shingles, link with nothing and are their own
    component. A null doc_id is a component_id only where a whole component has no other; rows
    that repeat a doc_id each give a row, other columns are not read, and an empty table gives
    an empty result. Texts of any length are compared whole.

    Two sets of similarity 0.85 share a band but for one pair in a million, and their sketches
    pass but for less; a higher similarity loses less. At other thresholds than 85 the bands
    (BANDS, PER_BAND) want choosing anew: at 80 one pair in ten thousand shares none.
    """
    most = most_differing(percent)
    source = id_text(docs, id_col, text_col).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = cut(source.mapInArrow(_signed(shingle), _SIGNED), "sets-rows")
    nodes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first(w).alias(w) for w in WORDS])
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()), "sets-nodes")
    placed = nodes.select("id", F.explode("bands").alias("h"))

    # Each text with one other: in each bucket any member, of these the nearest by sketch.
    heads = placed.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("h", "id").alias("o"), "id")).alias("head")).where("c > 1")
    shared = cut(placed.join(heads.select("h", F.col("head.id").alias("head")), "h").select("id", "head").distinct(), "sets-shared")
    sketches = nodes.select("id", "n", *WORDS)
    others = sketches.select(F.col("id").alias("head"), F.col("n").alias("m"), *[F.col(w).alias(f"t{w}") for w in WORDS])
    differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"t{w}"))) for w in WORDS), F.lit(0))
    sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    near = shared.where("id <> head").join(sketches, "id").join(others, "head").where(sized).withColumn("d", differing).where(F.col("d") <= most)
    near = cut(near.select("id", "n", "head", "d"), "sets-near")
    stars = near.groupBy("id").agg(F.min(F.struct("d", "head")).alias("best"), F.first("n").alias("n")).select("id", "n", F.col("best.head").alias("g"))
    stars = cut(stars, "sets-stars")
    wanted = cut(nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "key"), "sets-wanted")
    texts = texts_of(source, wanted, "sets-texts")
    links = confirmed(cut(starred(stars, wanted, group_shingles), "sets-groups"), texts, percent, shingle, "sets-links")
    labels = connected_components(links, "sets-cc")

    # Buckets that hold several components: what may link them, near by sketch, then confirmed.
    labelled = wanted.join(labels, wanted["id"] == labels["node"], "left").select("id", "key", F.coalesce("label", "id").alias("label"))
    labelled = cut(labelled, "sets-labelled")
    known = placed.join(labelled.select("id", "label"), "id")
    mark = [F.bit_xor(F.xxhash64("id", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
    mixed = known.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), *mark).where("lo < hi")
    # Of buckets with the same members one is enough.
    mixed = cut(mixed.groupBy("c", "x1", "x2").agg(F.min("h").alias("h")).select("h", "c"), "sets-mixed")
    open_ = cut(known.join(mixed.select("h"), "h").select("h", "id", "label"), "sets-open")
    crowded = mixed.where(F.col("c") > bucket_rows).select("h", F.ceil(F.col("c") / (bucket_rows / 2)).cast("int").alias("parts"))
    met = meeting(open_.join(sketches, "id"), "h", crowded).repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "id")
    maybe = cut(met.select("h", "p", "q", "id", "label", "n", *WORDS).mapInArrow(by_group(["h", "p", "q"], _near_forest(percent, most)), "a long, b long"), "sets-maybe")
    if not maybe.isEmpty():
        active = connected_components(maybe, "sets-active").select(F.col("node").alias("id"), F.col("label").alias("g"))
        active = cut(active.join(labelled, "id").join(nodes.select("id", "n"), "id").select("g", "id", "label", "key", "n"), "sets-joined")
        groups = meeting(active, "g", many(active, "g", F.col("n"), group_shingles)).withColumn("turn", F.lit(0))
        more = confirmed(groups, texts, percent, shingle, "sets-more")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more), "sets-cc")

    final = nodes.join(labels, nodes["id"] == labels["node"], "left").select("set_key", "least", F.coalesce("label", "id").alias("label"))
    final = cut(final, "sets-final")
    smallest = cut(final.groupBy("label").agg(F.min("least").alias("component_id")), "sets-least")
    table = cut(final.join(smallest, "label").select("set_key", "component_id"), "sets-table")
    found = rows.where("n > 0").select("doc_id", "key", "n", "set_key").join(table, "set_key").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(empty)
