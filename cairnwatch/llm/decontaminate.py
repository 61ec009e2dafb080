"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into segments of a bounded size. Each segment's postings
(term, positions) form one row of a written table: the index is partitioned by
document, so no term, however frequent, gathers in one place. Test items are looked
up in blocks of a bounded size, which are small enough to send to every segment: in
each segment the windows' lists are intersected, offset-adjusted, from the rarest term.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import cut, keyed_rows, row_key, slices, tidy

#: ASCII bytes outside a word; A-Z become a-z, all bytes of other code points stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Bytes of text in a segment, about, and bytes of test items in a block.
SEGMENT_BYTES, BLOCK_BYTES = 2_000_000, 4_000_000
#: Segments longer than this would overflow the packed 32-bit positions.
_MOST_POSITIONS = 2**31 - 1

INDEX = "segment long, keys binary, rows binary, n_words binary, starts binary, terms binary, term_ends binary, posting_ends binary, postings binary"


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII code points, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _index(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for part in slices(batches, most=SEGMENT_BYTES):
            each = [words(t) for t in part.column("text").to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            # Documents lie one after the other with a gap, so that no window spans two.
            starts = np.r_[0, np.cumsum(counts + gap)[:-1]]
            if len(starts) and starts[-1] + counts[-1] > _MOST_POSITIONS:
                raise ValueError("a single text has too many words for one segment")
            flat = pa.array([w for ws in each for w in ws], pa.binary()).dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False)
            place = np.repeat(starts, counts) + np.arange(len(codes)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
            terms = flat.dictionary.to_pylist()
            by_term = np.argsort(codes, kind="stable")
            df = np.bincount(codes, minlength=len(terms)) if len(terms) else np.zeros(0, np.int64)
            packed = {
                "segment": (task << 32) + made,
                "keys": b"".join(part.column("key").to_pylist()),
                "rows": part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(),
                "n_words": counts.astype("<i8").tobytes(),
                "starts": starts.astype("<i8").tobytes(),
                "terms": b"".join(terms),
                "term_ends": np.cumsum([len(t) for t in terms], dtype="<i8").tobytes() if terms else b"",
                "posting_ends": np.cumsum(df).astype("<i8").tobytes(),
                "postings": place[by_term].astype("<u4").tobytes(),
            }
            made += 1
            yield pa.RecordBatch.from_pylist([packed], schema=_INDEX_SCHEMA)

    return run


_INDEX_SCHEMA = pa.schema([("segment", pa.int64())] + [(c, pa.binary()) for c in ("keys", "rows", "n_words", "starts", "terms", "term_ends", "posting_ends", "postings")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """Writes the positional index of docs to the shared folder and returns it, a row per segment.

    gap: empty positions between documents; phrases and proximities shorter than it can't span two.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return cut(rows.mapInArrow(_index(gap), INDEX), "positional-index")


class Segment:
    """One segment of the index, with its dictionary and postings unpacked."""

    def __init__(self, row: dict) -> None:
        self.n_words = np.frombuffer(row["n_words"], "<i8")
        n = len(self.n_words)
        ids, null = np.frombuffer(row["rows"][: 8 * n], "<i8"), np.frombuffer(row["rows"][8 * n :], "u1")
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.keys = [row["keys"][i : i + 16] for i in range(0, 16 * n, 16)]
        self.starts = np.frombuffer(row["starts"], "<i8")
        ends = np.frombuffer(row["term_ends"], "<i8").tolist()
        self.codes = {row["terms"][s:e]: i for i, (s, e) in enumerate(zip([0, *ends], ends))}
        self.posting_ends = np.r_[0, np.frombuffer(row["posting_ends"], "<i8")]
        self.postings = np.frombuffer(row["postings"], "<u4")

    def list_of(self, code: int) -> np.ndarray:
        return self.postings[self.posting_ends[code] : self.posting_ends[code + 1]]

    def phrase(self, codes: list[int]) -> np.ndarray:
        """Start positions of an exact phrase: offset-adjusted lists, intersected from the rarest term."""
        by_df = sorted(range(len(codes)), key=lambda i: self.posting_ends[codes[i] + 1] - self.posting_ends[codes[i]])
        starts = None
        for i in by_df:
            listed = self.list_of(codes[i])
            if starts is None:
                starts = listed.astype(np.int64) - i
                continue
            at = np.searchsorted(listed, starts + i)
            at[at == len(listed)] = 0
            starts = starts[listed[at] == starts + i]
            if not len(starts):
                break
        return starts

    def near(self, codes: list[int], span: int) -> np.ndarray:
        """Positions of the rarest term with every other term within `span` words before or after."""
        by_df = sorted(codes, key=lambda c: self.posting_ends[c + 1] - self.posting_ends[c])
        at = self.list_of(by_df[0]).astype(np.int64)
        for c in by_df[1:]:
            listed = self.list_of(c).astype(np.int64)
            i = np.searchsorted(listed, at - span)
            ok = i < len(listed)
            ok[ok] = listed[i[ok]] <= at[ok] + span
            at = at[ok]
            if not len(at):
                break
        return at


def _windows(items: list[tuple[int, list[bytes]]], size: int) -> list[tuple[tuple[bytes, ...], list[int]]]:
    """Distinct windows with the items that have them; an item of fewer words is one window."""
    owners: dict[tuple[bytes, ...], list[int]] = {}
    for item, ws in items:
        for i in range(max(1, len(ws) - size + 1)) if ws else ():
            mine = owners.setdefault(tuple(ws[i : i + size]), [])
            if not mine or mine[-1] != item:
                mine.append(item)
    return list(owners.items())


def _lookup(items: list[tuple[int, list[bytes]]], size: int, span: int | None, all_rows: bool = True):
    """Rows (doc_id, key, n_words, hit positions, items) of every document of each segment, or of those with hits alone."""
    windows = _windows(items, size)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in windows for w in ws))}
    lengths = np.array([len(ws) for ws, _ in windows], np.int64)
    flat = np.array([vocabulary[w] for ws, _ in windows for w in ws], np.int64)
    begins = np.r_[0, np.cumsum(lengths)[:-1]] if len(windows) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                known = np.full(len(vocabulary), -1, np.int64)
                for w in vocabulary.keys() & seg.codes.keys():
                    known[vocabulary[w]] = seg.codes[w]
                alive = np.flatnonzero(np.minimum.reduceat(known[flat], begins) >= 0) if len(flat) else ()
                hits: dict[int, list[tuple[int, int]]] = {}
                found: dict[int, set[int]] = {}
                close: dict[int, set[int]] = {}
                for w in alive:
                    n = int(lengths[w])
                    codes = known[flat[begins[w] : begins[w] + n]].tolist()
                    for p in seg.phrase(codes).tolist():
                        d = int(np.searchsorted(seg.starts, p, "right")) - 1
                        hits.setdefault(d, []).append((p, p + n))
                        found.setdefault(d, set()).update(windows[w][1])
                    if span is not None:
                        for p in seg.near(list(dict.fromkeys(codes)), span).tolist():
                            d = int(np.searchsorted(seg.starts, p, "right")) - 1
                            close.setdefault(d, set()).update(windows[w][1])
                out = {"doc_id": seg.doc_ids, "key": seg.keys, "n_words": seg.n_words, "spans": [], "items": [], "near_items": []}
                for d in range(len(seg.keys)):
                    merged: list[list[int]] = []
                    for s, e in sorted((s - int(seg.starts[d]), e - int(seg.starts[d])) for s, e in hits.get(d, ())):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    out["spans"].append([{"s": s, "e": e} for s, e in merged])
                    out["items"].append(sorted(found.get(d, ())))
                    out["near_items"].append(sorted(close.get(d, ())))
                found_in = pa.RecordBatch.from_pydict(out, schema=_MATCH_SCHEMA)
                if not all_rows:
                    found_in = found_in.take(pa.array([d for d in range(len(seg.keys)) if d in hits or d in close], pa.int64()))
                yield found_in

    return run


_MATCH_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64())),
])
_MATCH = "doc_id long, key binary, n_words long, spans array<struct<s: long, e: long>>, items array<long>, near_items array<long>"


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Test items in blocks of at most `most` bytes (one item at least), streamed to the driver."""
    block, size = [], 0
    rows = items.select(items[id_col].cast("long").alias("i"), items[text_col].cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > most:
            yield block
            block, size = [], 0
        block.append((r.i, words(r.t)))
        size += len(r.t)
    yield block


@tidy
def matches(docs: DataFrame, items: DataFrame, window: int = 10, near_span: int | None = None, item_col: str = "item_id", gap: int = 64) -> DataFrame:
    """(doc_id, key, n_words, spans, items, near_items) for each row of docs.

    spans: disjoint word ranges [s, e) that lie inside occurrences of windows of `window`
    consecutive words of an item (a shorter item is one window); items: ids of the items
    that have such windows; near_items: with near_span, items of which all words of one
    window lie within that many words of its rarest. Null and empty texts have no words
    and no hits; items without text, words or id are left out; an item that repeats counts
    once, a row that repeats has its own row; an empty table of either kind gives no hits. Columns beyond ids and texts
    are not read.

    Items are looked up in blocks of BLOCK_BYTES, each a pass over the written index; one
    block, the usual case, needs no shuffle. Of several, only documents with hits move, are
    merged by key and joined to the others.
    """
    if max(window, near_span or 0) >= gap:
        raise ValueError("gap must exceed the window and the span")
    index = build_index(docs, gap=gap)
    blocks = _blocks(items, item_col, "text", BLOCK_BYTES)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return index.mapInArrow(_lookup(first, window, near_span), _MATCH)
    found = None
    for block in itertools.chain((first, second), blocks):
        got = cut(index.mapInArrow(_lookup(block, window, near_span, False), _MATCH), "block-hits")
        found = got if found is None else found.unionByName(got)
    every = index.mapInArrow(_lookup([], window, None), _MATCH).select("doc_id", "key", "n_words")
    none = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items", "near_items")]
    return every.join(cut(_merged(found), "block-merged"), "key", "left").select("doc_id", "key", "n_words", *none)


def _merged(hits: DataFrame) -> DataFrame:
    """(key, spans, items, near_items): the hits of several blocks united, a row a key."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        spans: list[list[int]] = []
        for s, e in sorted((x["s"], x["e"]) for xs in pdf["spans"] for x in xs):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        one = {c: [sorted({i for xs in pdf[c] for i in xs})] for c in ("items", "near_items")}
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "spans": [[{"s": s, "e": e} for s, e in spans]], **one})

    return hits.dropDuplicates().groupBy("key").applyInPandas(merge, "key binary, spans array<struct<s: long, e: long>>, items array<long>, near_items array<long>")


def digest(items: list[int] | np.ndarray) -> str:
    """Lowercase hex SHA-256 of ids sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


@tidy
def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold a window of an item; all columns are kept, whatever their names.

    Null and empty texts stay; rows that repeat go or stay alike; texts of any length are
    searched whole; an empty table of either kind leaves docs as they are.
    """
    hit = matches(docs, items, window).where(F.size("spans") > 0).select("key").distinct()
    return keyed_rows(docs).join(cut(hit, "contaminated"), "key", "left_anti").select("row.*")
