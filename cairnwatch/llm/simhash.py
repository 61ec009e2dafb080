"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant that lies within
r/2 flips of both. Every distinct fingerprint therefore emits all variants within
half the radius (2,081 of them for r = 4), variants meet by a shuffle, and every
set that meets on a variant is linked. Sending each variant as a row would move
2,081 rows for each fingerprint; the leading bits of a variant decide where it
meets, so a fingerprint is sent once to every block that holds any of its variants
and only the variants of that block are laid out there. Same variants, same
meetings, about a fiftieth of the rows. Blocks too full for a task are split on
further bits.

Members of one variant are within r of each other by the triangle inequality, so a
star to the first links them all and no pairs of a group are listed. Links are
verified by bit count, then turned into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwatch.llm.common import connected_components, cut, id_text, keyed_rows, mix, row_key, slices, text_key, tidy
from cairnwatch.llm.groups import confirmed, many, meeting, searched, shingle_sets, starred, texts_of

#: Variants that one block lays out at most, about; it bounds a task's memory.
BLOCK_VARIANTS = 2_500_000


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text: unsigned; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    total = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([simhash(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp) for each row; fp holds the 64 bits as a signed long, key stands for id and text."""
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, key binary, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All words with at most `flips` of the lowest `bits` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def _forest(first: np.ndarray, other: np.ndarray) -> list[int]:
    """Positions of a spanning forest's edges, so that a block passes on fewer links than it has members."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(first.tolist(), other.tolist())):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def collisions(fps: np.ndarray, used: np.ndarray, low_bits: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, owner, variants) where more than one member of a block has a variant, sorted; groups index the variants, owners fps.

    used: flips already spent on the block's leading bits; the lowest low_bits are varied.
    """
    low = np.uint64((1 << low_bits) - 1)
    none = np.zeros(0, np.int64)
    variants, owners = [], []
    for spent in range(half + 1):
        own = np.flatnonzero(used == spent)
        if len(own):
            masks = _masks(low_bits, half - spent)
            variants.append(((fps[own] & low)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(masks)))
    if not variants:
        return none, none, none
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variant)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return none, none, none
    at = np.minimum(np.searchsorted(shared, variant), len(shared) - 1)
    hit = shared[at] == variant
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    return at[order], owner[order], shared


def _heads(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first owner of each row's group."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(owner[begins], np.diff(np.r_[begins, len(group)]))


def meetings(fps: np.ndarray, used: np.ndarray, low_bits: int, radius: int) -> list[tuple[int, int]]:
    """A forest of links, within `radius` bits each, among the distinct fingerprints (unsigned) of a block.

    A star to a member within radius // 2 flips of the variant: all others are within the
    rest of the radius. Two fingerprints that near each other have a variant like that.
    """
    group, owner, variants = collisions(fps, used, low_bits, -(-radius // 2))
    if radius % 2 and len(group):
        low = np.uint64((1 << low_bits) - 1)
        near = used[owner] + np.bitwise_count((fps[owner] & low) ^ variants[group]) <= radius // 2
        order = np.lexsort((owner, ~near, group))
        group, owner, near = group[order], owner[order], near[order]
        has = _heads(group, near)
        group, owner = group[has], owner[has]
    if not len(group):
        return []
    head = _heads(group, owner)
    pairs = np.unique(np.stack([head, owner], 1)[head != owner], axis=0)
    return [tuple(pairs[i].tolist()) for i in _forest(pairs[:, 0], pairs[:, 1])]


def _block(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        links = meetings(fps, pdf["used"].to_numpy(), 64 - int(pdf["depth"].iloc[0]), radius)
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": [signed[i] for i, _ in links], "b": [signed[j] for _, j in links]}).astype("int64")

    return run


def _routed(df: DataFrame, more: int, half: int, width: int = 64) -> DataFrame:
    """Deals rows (fp, depth, block, used, ...) on by `more` further leading bits of `width`, spending flips on them."""
    masks = [[int(m), int(m).bit_count()] for m in _masks(more, half)]
    options = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in masks])
    shifted = F.expr(f"shiftrightunsigned(fp, {width} - (depth + {more})) & {(1 << more) - 1}L")
    rest = [c for c in df.columns if c not in ("fp", "depth", "block", "used")]
    return df.withColumn("_o", F.explode(F.filter(options, lambda o: o["k"] + F.col("used") <= half))).select(
        *rest,
        "fp",
        (F.col("depth") + more).alias("depth"),
        F.expr(f"shiftleft(block, {more})").bitwiseOR(shifted.bitwiseXOR(F.col("_o.m"))).alias("block"),
        (F.col("used") + F.col("_o.k")).cast("int").alias("used"),
    )


def links(nodes: DataFrame, radius: int = 4, block_variants: int = BLOCK_VARIANTS) -> DataFrame:
    """(a, b) of distinct fingerprints `nodes.fp` whose components equal those of all pairs within `radius`.

    radius: even or odd; variants lie within ceil(radius / 2) flips, and one end of a link
    within floor(radius / 2) of a common one.
    """
    half = -(-radius // 2)
    n, ball = nodes.count(), len(_masks(64, half))
    bits = min(20, max(0, math.ceil(math.log2(max(1, n * ball / block_variants)))))
    rows = nodes.select("fp", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("used"))
    rows = _routed(rows, bits, half) if bits else rows
    done, columns = [], ["fp", "depth", "block", "used"]
    for depth in range(bits, 61, 4):
        laid = [len(_masks(64 - depth, half - spent)) for spent in range(half + 1)]
        each = F.element_at(F.array(*map(F.lit, laid)), F.col("used") + 1)
        full = rows.groupBy("block").agg(F.sum(each).alias("laid")).where(F.col("laid") > 3 * block_variants)
        full = cut(full.select("block"), "simhash-full")
        if full.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(full, "block", "left_anti").select(columns))
        rows = _routed(rows.join(full, "block", "left_semi").select(columns), 4, half)
    else:
        done.append(rows)
    found = None
    for part in done:
        got = part.groupBy("depth", "block").applyInPandas(_block(radius), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
        found = got if found is None else found.unionByName(got)
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, key, fp, label, component_id) for each row of docs.

    Rows link where their fingerprints differ in `radius` bits at most; component_id is
    the smallest doc_id reachable and label a fingerprint that stands for the component. Null and empty texts have fingerprint 0 and link like
    any other. A null doc_id is never a component_id unless its whole component has none
    (then component_id is null). Rows that repeat a doc_id each get their own row; columns
    beyond id and text are not read. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = connected_components(links(nodes.select("fp"), radius), "simhash-cc")
    labelled = cut(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    smallest = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    table = cut(labelled.join(smallest, "label").select("fp", "label", "component_id"), "simhash-table")
    return rows.join(table, "fp").select("doc_id", "key", "fp", "label", "component_id")


#: Sub-fingerprints for similarity search: so many bands of so many bits out of 256, within so many differing bits.
BANDS, BAND_BITS, BAND_RADIUS = 24, 40, 4
BAND_OF = np.array([np.random.default_rng(7 + b).choice(256, BAND_BITS, replace=False) for b in range(BANDS)])
#: Texts of similarity 0.8 differ in 39 of 256 bits on average (standard deviation 6; 48 between four and five shingles).
MOST_DIFFERING = 72
#: Fingerprints that one block of a band holds at most (about 70 bytes each), and variants laid out at a time; both bound a task's memory.
BLOCK_ROWS, PART_VARIANTS = 1_000_000, 1_000_000
#: Shingles of a group that one task compares at most; larger groups go in parts.
GROUP_SHINGLES = 1_000_000
#: Members of a variant up to which their pairs are laid out at once.
FEW = 6
WORDS = ["f0", "f1", "f2", "f3"]


def wide_bits(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, n): 256 SimHash bits of each text's distinct word shingles, a row a text, all 0 without words; and their number."""
    begins, h = shingle_sets(texts, shingle)
    bits = np.zeros((len(texts), 256), np.uint8)
    for i in range(len(texts)):
        own = h[begins[i] : begins[i + 1]]
        counts = np.zeros(256, np.int64)
        for s in range(0, len(own), 1 << 14):
            four = np.stack([mix(own[s : s + (1 << 14)] ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))) for j in range(4)], 1)
            counts += np.unpackbits(four.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        bits[i] = 2 * counts > len(own)
    return bits, np.diff(begins)


def _wide(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bits, n = wide_bits(part.column("text").to_pylist(), shingle)
            four = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            columns = [part.column(c) for c in ("doc_id", "key", "text_key")] + [pa.array(n, pa.int64())] + [pa.array(four[:, j]) for j in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "text_key", "n", *WORDS])

    return run


def band(four: np.ndarray, b: int) -> np.ndarray:
    """Sub-fingerprint b of fingerprints given as rows of four words."""
    out = np.zeros(len(four), np.uint64)
    for at in range(0, len(four), 1 << 15):
        bits = np.unpackbits(np.ascontiguousarray(four[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
        packed = np.zeros((len(bits), 8), np.uint8)
        packed[:, : BAND_BITS // 8] = np.packbits(bits[:, BAND_OF[b]], axis=1, bitorder="little")
        out[at : at + (1 << 15)] = packed.view(np.uint64).ravel()
    return out


Chunk = tuple[int, int]


def chunked(agree: int) -> list[tuple[tuple[Chunk, ...], tuple[Chunk, ...]]]:
    """Ways to choose `agree` of BAND_RADIUS + agree chunks (first bit, bits) of a band: (those chosen, the others).

    Two bands within BAND_RADIUS bits are equal in `agree` chunks at least, so they meet in some
    way's block. More chunks give smaller blocks for more ways: 1, 5, 15, 35 and 70 of 0, 8, 13,
    17 and 20 bits.
    """
    edges = np.linspace(0, BAND_BITS, BAND_RADIUS + agree + 1).round().astype(int).tolist()
    chunks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [(own, tuple(c for c in chunks if c not in own)) for own in combinations(chunks, agree)]


def _bits_of(fps: np.ndarray, chunks: tuple[Chunk, ...]) -> tuple[np.ndarray, int]:
    """The bits of some chunks side by side, and how many they are."""
    out, n = np.zeros(len(fps), np.uint64), 0
    for at, wide in chunks:
        out |= ((fps >> np.uint64(at)) & np.uint64((1 << wide) - 1)) << np.uint64(n)
        n += wide
    return out, n


def _agreeing(texts: int, block_rows: int) -> int:
    """Chunks that must agree so that an even block of so many texts holds half of block_rows at most; four at most."""
    if texts <= block_rows:
        return 0
    fitting = (m for m in range(1, 4) if texts / (1 << min(sum(b for _, b in own) for own, _ in chunked(m))) <= block_rows / 2)
    return next(fitting, 4)


def _to_blocks(agree: int):
    """Sends each fingerprint, for each band, to the blocks where it can meet others within BAND_RADIUS."""
    ways = chunked(agree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            four = np.stack([batch.column(c).to_numpy() for c in WORDS], 1)
            for b in range(BANDS):
                fps = band(four, b)
                for w, (own, _) in enumerate(ways):
                    to = [pa.array(np.full(len(four), b, np.int32)), pa.array(np.full(len(four), w, np.int32)), pa.array(_bits_of(fps, own)[0].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(to + [batch.column(x) for x in ("id", "label", *WORDS)], ["band", "way", "block", "id", "label", *WORDS])

    return run


_PLACED = "band int, way int, block long, id long, label long, f0 long, f1 long, f2 long, f3 long"
_BLOCK = ["band", "way", "block"]


def _apart(four: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of each pair, few pairs at a time."""
    out = np.zeros(len(left), np.int16)
    for at in range(0, len(left), 1 << 16):
        out[at : at + (1 << 16)] = np.bitwise_count(four[left[at : at + (1 << 16)]] ^ four[right[at : at + (1 << 16)]]).sum(1)
    return out


def _near_edges(four: np.ndarray, label: np.ndarray, group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child, head, differing bits): edges that join what the pairs of a variant's members join, each pair of two labels and near.

    group, owner: members of each variant, sorted. Of variants with the same members one is
    enough. The pairs of a few members are laid out; of many, a search from member to member
    gives the edges that reach new ones, so that they are fewer than the members.
    """
    none = np.zeros(0, np.int64)
    if not len(group):
        return none, none, none
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    marks = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), starts)
    differ = np.minimum.reduceat(label[owner], starts) != np.maximum.reduceat(label[owner], starts)
    _, first = np.unique(np.stack([marks, size.astype(np.uint64)], 1), axis=0, return_index=True)
    chosen = np.zeros(len(starts), bool)
    chosen[first] = True
    chosen &= differ
    keep = np.repeat(chosen & (size <= FEW), size)
    g, o = group[keep], owner[keep]
    codes, total = [], len(label)
    for k in range(1, FEW):
        together = g[:-k] == g[k:]
        codes.append(np.unique(o[k:][together] * total + o[:-k][together]))
    child, head = np.divmod(np.unique(np.concatenate(codes)), total)
    apart = _apart(four, child, head)
    near = (apart <= MOST_DIFFERING) & (label[child] != label[head])
    found = [(child[near], head[near], apart[near])]
    for i in np.flatnonzero(chosen & (size > FEW)).tolist():
        own = owner[starts[i] : starts[i] + size[i]]

        def reached(p: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[label[own[rest]] != label[own[p]]]
            return rest[np.bitwise_count(four[own[rest]] ^ four[own[p]]).sum(1) <= MOST_DIFFERING]

        a, b = searched(len(own), reached)
        found.append((own[b], own[a], _apart(four, own[b], own[a])))
    return tuple(np.concatenate(side) for side in zip(*found))


def _block_forest(agree: int, part_variants: int):
    """A spanning forest (a, b, d) of a block's colliding pairs of two labels that differ in d <= MOST_DIFFERING bits, by least d.

    The variants are laid out part by part and each part's edges thinned to a forest with those
    before, so that memory stays bounded.
    """
    ways, half = chunked(agree), BAND_RADIUS // 2

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids, label = ids[order], np.unique(table.column("label").to_numpy()[order], return_inverse=True)[1]
        four = np.stack([table.column(c).to_numpy() for c in WORDS], 1)[order].view(np.uint64)
        del table, order
        fps, low = _bits_of(band(four, key[0].as_py()), ways[key[1].as_py()][1])
        more = min(low, max(0, math.ceil(math.log2(max(1, len(fps) * len(_masks(low, half)) / part_variants)))))
        lead = (fps >> np.uint64(low - more)) & np.uint64((1 << more) - 1)
        kept = (np.zeros(0, np.int64),) * 3
        for part in range(1 << more):
            spent = np.bitwise_count(lead ^ np.uint64(part))
            own = np.flatnonzero(spent <= half)
            group, owner, _ = collisions(fps[own], spent[own], low - more, half)
            found = _near_edges(four, label, group, own[owner].astype(np.int64))
            if len(found[0]):
                child, head, apart = (np.concatenate(pair) for pair in zip(kept, found))
                order = np.lexsort((head, child, apart))
                tree = order[_forest(child[order], head[order])]
                kept = child[tree], head[tree], apart[tree]
        return pa.table({"a": pa.array(ids[kept[0]], pa.int64()), "b": pa.array(ids[kept[1]], pa.int64()), "d": pa.array(kept[2].astype(np.int64))})

    return run


def _near_forest(nodes: DataFrame, agree: int, part_variants: int, block_rows: int, tag: str) -> DataFrame:
    """(a, b, d) from all blocks of nodes (id, label, *WORDS); a block with more than block_rows goes in parts."""
    placed = nodes.mapInArrow(_to_blocks(agree), _PLACED)
    if agree:
        placed = meeting(placed, _BLOCK, cut(many(placed, _BLOCK, F.lit(1), block_rows), tag))
    else:
        placed = placed.select("*", F.lit(0).alias("p"), F.lit(0).alias("q"))
    return cut(placed.groupBy(*_BLOCK, "p", "q").applyInArrow(_block_forest(agree, part_variants), "a long, b long, d long"), tag)


@tidy
def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, part_variants: int = PART_VARIANTS, block_rows: int = BLOCK_ROWS, group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """(doc_id, key, label) for each row of docs: rows of one label are linked by similar or equal texts.

    Texts are similar whose sets of word shingles have a Jaccard similarity of `similarity`
    or more. At 0.8, fingerprints of 64 bits differ in ten bits, too many for half-radius
    variants; so 256 bits are taken in BANDS overlapping sub-fingerprints, each ball-hashed
    by itself, and colliding pairs are verified: by all 256 bits where they meet, then by
    the shingles themselves. At exactly 0.8 about nineteen of twenty pairs meet, at 0.85
    nearly all.

    A block hands on a spanning forest of its near pairs, and the forests' components are the
    groups whose texts are compared, each in one task, where every pair of two components is
    verified or skipped as already linked. Of a group too large for a task each text is first
    compared with its nearest one only, which makes a group of copies one component; where
    several are left, a second pass over the bits finds the texts near other components, and
    these go in parts, each two of which meet. So every colliding pair is verified or in one
    group at any size; texts of one task that are similar without colliding are linked as well.
    Null and empty texts are alike.
    """
    percent = round(100 * similarity)
    source = id_text(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = source.withColumn("text_key", text_key(F.col("text")))
    rows = cut(rows.mapInArrow(_wide(shingle), "doc_id long, key binary, text_key binary, n long, f0 long, f1 long, f2 long, f3 long"), "similar-rows")
    nodes = rows.groupBy("text_key").agg(F.min("key").alias("key"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in WORDS])
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()), "similar-nodes")
    agree = _agreeing(nodes.count(), block_rows)

    forest = _near_forest(nodes.select("id", F.col("id").alias("label"), *WORDS), agree, part_variants, block_rows, "similar-forest")
    placed = connected_components(forest.select("a", "b"), "similar-groups").select(F.col("node").alias("id"), F.col("label").alias("g"))
    members = cut(placed.join(nodes.select("id", "key", "n"), "id"), "similar-members")
    texts = texts_of(source, members, "similar-texts")
    large = cut(many(members, "g", F.col("n"), group_shingles), "similar-large")
    whole = members.join(large, "g", "left_anti").select("g", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("turn"), "id", F.col("id").alias("label"), "key")
    links = confirmed(whole, texts, percent, shingle, "similar-links")
    if not large.isEmpty():
        links = links.unionByName(_large_groups(nodes, forest, members.join(large, "g", "left_semi"), texts, percent, shingle, agree, part_variants, block_rows, group_shingles))
    labels = connected_components(links, "similar-cc")
    labelled = nodes.join(labels, nodes["id"] == labels["node"], "left").select("text_key", F.coalesce("label", "id").alias("label"))
    return rows.select("doc_id", "key", "text_key").join(cut(labelled, "similar-labels"), "text_key").select("doc_id", "key", "label")


@tidy
def _large_groups(
    nodes: DataFrame, forest: DataFrame, members: DataFrame, texts: DataFrame, percent: int, shingle: int, agree: int, part_variants: int, block_rows: int, group_shingles: int
) -> DataFrame:
    """Links (a, b) within groups (g, id, key, n) that no task holds: with the nearest text, then between what is left apart."""
    nearest = forest.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select(F.col("a").alias("id"), F.col("best.b").alias("head"))
    stars = cut(members.join(nearest, "id").select("id", "n", F.col("head").alias("g")), "similar-stars")
    links = confirmed(starred(stars, members.select("id", "key"), group_shingles), texts, percent, shingle, "similar-links")
    labels = connected_components(links, "similar-cc").withColumnRenamed("node", "id")
    labelled = cut(members.join(labels, "id", "left").select("g", "id", "key", "n", F.coalesce("label", "id").alias("label")), "similar-labelled")
    apart = labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    open_ = cut(labelled.join(apart.select("g"), "g", "left_semi").select("id", "label", "key", "n"), "similar-open")
    if open_.isEmpty():
        return links
    bits = open_.select("id", "label").join(nodes.select("id", *WORDS), "id")
    maybe = _near_forest(bits, agree, part_variants, block_rows, "similar-maybe").select("a", "b")
    if maybe.isEmpty():
        return links
    active = connected_components(maybe, "similar-active").select(F.col("node").alias("id"), F.col("label").alias("g"))
    active = cut(active.join(open_, "id"), "similar-joined")
    groups = meeting(active, "g", many(active, "g", F.col("n"), group_shingles)).withColumn("turn", F.lit(0))
    return links.unionByName(confirmed(groups, texts, percent, shingle, "similar-links"))


@tidy
def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group of similar texts the row with the smallest doc_id stays.

    A group whose rows all lack a doc_id keeps one row too; of rows that repeat both id and
    text the one with the smallest hash of all its columns, as JSON, stays. Null and empty
    texts are alike, so one row of them stays; texts of any length are compared whole. All
    columns of docs are kept as they are, whatever their names and types; an empty table gives
    an empty result.
    """
    found = similar_groups(docs, shingle, similarity)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("best"))
    chosen = best.select(F.col("best.key").alias("key"))
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    chosen = cut(chosen.join(counts, "key"), "simhash-chosen")
    rows = keyed_rows(docs)
    kept = rows.join(chosen.where("n = 1"), "key", "left_semi")
    repeated = chosen.where("n > 1").select("key")
    if not repeated.isEmpty():
        again = rows.join(repeated, "key").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.unionByName(again)
    return kept.select("row.*")
