"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Every shingle is hashed once; the hash's leading bits choose a bin and each bin keeps its
least hash. Empty bins borrow from a non-empty one, each by its own random order of the
bins (optimal densification), so that two texts borrow alike. The low-order byte of each
bin is stored, and estimates are corrected for bytes that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import Spans, mix, row_key, shuffle_width, slices

BINS, BITS, SHINGLE = 256, 8, 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def orders(bins: int = BINS, seed: int = 20140622) -> np.ndarray:
    """For each bin the order in which it looks for a bin to borrow from."""
    return np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all word shingles of lower-cased texts; a text of fewer words is one shingle."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = Spans(data).hashes(starts, ends)
    text = np.searchsorted(ends_of, starts, "right")
    lanes = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    counts = np.bincount(text, minlength=len(texts))
    found_text, found = [], []
    if len(word) >= size:
        h = np.zeros(len(word) - size + 1, np.uint64)
        for j in range(size):
            h += word[j : len(word) - size + 1 + j] * lanes[j]
        whole = text[: len(h)] == text[size - 1 :]
        found_text.append(text[: len(h)][whole])
        found.append(mix(h[whole]))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(text, short)
        h = counts[short].astype(np.uint64)
        for j in range(size - 1):
            at = np.minimum(first + j, len(word) - 1)
            h = h + np.where(counts[short] > j, word[at] * lanes[j], np.uint64(0))
        found_text.append(short)
        found.append(mix(h))
    return np.concatenate(found_text), np.concatenate(found)


def fingerprint(texts: list[str | None], bins: int = BINS, size: int = SHINGLE, order: np.ndarray | None = None) -> list[bytes]:
    """Packed fingerprints of texts, a byte a bin; b'' for a text without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    text, h = shingle_hashes(raw, size)
    shift = np.uint64(64 - (bins - 1).bit_length())
    least = np.full(len(texts) * bins, _EMPTY, np.uint64)
    np.minimum.at(least, text * bins + (h >> shift).astype(np.int64), h)
    least = least.reshape(len(texts), bins)
    full = least != _EMPTY
    some = full.any(axis=1)
    order = orders(bins) if order is None else order
    row, col = np.nonzero(~full & some[:, None])
    turn = 0
    while len(row):
        lender = order[col, turn]
        ok = full[row, lender]
        least[row[ok], col[ok]] = least[row[ok], lender[ok]]
        row, col, turn = row[~ok], col[~ok], turn + 1
    packed = (least & np.uint64(0xFF)).astype(np.uint8)
    return [packed[i].tobytes() if some[i] else b"" for i in range(len(texts))]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement; texts without words are alike."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 1 / (1 << bits)
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of a text replaced by the first as many code points of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(bins: int, size: int):
    """Walks rows sorted by range and descending id; the row after each is the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders(bins)
        held = None  # (range, ghost, doc_id, text, fingerprint) of the row whose next isn't known yet
        for part in slices(batches, most=1_000_000):
            cols = [part.column(c).to_pylist() for c in ("range", "ghost", "doc_id", "text")]
            texts = [t or "" for t in cols[3]]
            rows = [*([held] if held else []), *zip(*cols[:3], texts, fingerprint(texts, bins, size, order))]
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            if not pairs:
                continue
            changed = [edited(a[3], b[3]) for a, b in pairs]
            marks = fingerprint(changed, bins, size, order)
            columns = [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([a[4].hex() for a, _ in pairs]),
                pa.array([m.hex() for m in marks]),
                pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text, of its edited form and their likeness to it and to the next document (SCHEMA).

    The next document is that of the next smaller id, after the last the first; rows of null
    id come last, rows that tie follow by a hash of their text, and rows that repeat both in
    any order. Null texts are empty; a text without words has the fingerprint ''. Texts move
    once: ids are cut into ranges of equal counts, and the first row of each range is sent to
    the range before it as well. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    n = 2 * shuffle_width(spark)
    marks = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = sorted({min(int(m), (1 << 63) - 1) for m in marks})  # quantiles are doubles
    # The range is the number of cuts below the id, found by bisection in a literal array.
    above = F.lit(0)
    if cuts:
        above = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(above).cast("int"))
    keyed = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    firsts = keyed.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.bitwise_not("doc_id").alias("falling"), "key")).alias("f"))
    found = sorted(((r["range"], bytes(r["f"]["key"])) for r in firsts.select("range", "f").collect()), reverse=True)  # a row a range
    if not found:
        return spark.createDataFrame([], SCHEMA)
    sent = [(key, found[i - 1][0] if i else found[-1][0]) for i, (_, key) in enumerate(found)]
    ghosts = F.broadcast(spark.createDataFrame(sent, "key binary, to int"))  # 2 x shuffle partitions rows at most
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("to").alias("range"), F.lit(True).alias("ghost"))
    dealt = keyed.join(ghosts, "key", "left").withColumn("_o", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select("doc_id", "text", "key", F.col("_o.range").alias("range"), F.col("_o.ghost").alias("ghost"))
    placed = dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "key")
    return placed.select("range", "ghost", "doc_id", "text").mapInArrow(_pairs(bins, size), SCHEMA)
