"""Groups of texts that may be near-duplicates, confirmed where they meet on their full sets of shingles.

A group's texts come to one task, which searches from text to text and passes over those that
it has reached: alike texts cost one comparison each, and no pair leaves the task but the
edges of a spanning forest. A group too large for a task goes in parts, each two of which meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import cut
from cairnwatch.llm.minhash import shingle_hashes


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, hashes): the distinct shingles of text i, sorted, are hashes[begins[i]:begins[i + 1]]; A-Z are lower-cased."""
    at, h = shingle_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], shingle)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    if len(h):
        new = np.r_[True, (at[1:] != at[:-1]) | (h[1:] != h[:-1])]
        at, h = at[new], h[new]
    return np.searchsorted(at, np.arange(len(texts) + 1)), h


def alike(both: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    return 100 * both >= percent * (left + right - both)


def by_group(keys: list[str], work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """Hands the rows of each group to `work`, a group at a time, from partitions sorted by `keys`; gives its links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, found, size = [], None, [], 0

        def links() -> pa.RecordBatch:
            a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [np.asarray(batch.column(k)) for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if s == e:
                    continue
                own = tuple(c[s] for c in columns)
                if held and own != of:
                    found.append(work(pa.Table.from_batches(held)))
                    size, held = size + len(found[-1][0]), []
                    if size > 10_000 or len(found) > 1_000:
                        yield links()
                        found, size = [], 0
                held.append(batch.slice(s, e - s))
                of = own
        if held:
            found.append(work(pa.Table.from_batches(held)))
        yield links()

    return run


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name), np.int64)


def searched(n: int, reached: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of a breadth-first search over 0..n-1; reached(p, rest) gives those of `rest` next to p."""
    rest, heads, tails = np.arange(n), [], []
    while len(rest):
        turn, rest = [int(rest[0])], rest[1:]
        for p in turn:  # grows on the way
            if not len(rest):
                break
            found = reached(p, rest)
            if len(found):
                heads.append(np.full(len(found), p))
                tails.append(found)
                rest = np.setdiff1d(rest, found, assume_unique=True)
                turn.extend(found.tolist())
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (np.zeros(0, np.int64),) * 2


def confirmed_forest(percent: int, shingle: int):
    """A spanning forest of the pairs of a group that lie in two components and are similar by their full sets."""

    def work(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.unique(numbers(table, "id"), return_index=True)
        order = np.argsort(numbers(table, "turn")[first], kind="stable")
        ids, first = ids[order], first[order]
        labels = numbers(table, "label")[first]
        begins, h = shingle_sets(table.column("text").take(pa.array(first)).to_pylist(), shingle)
        n = np.diff(begins)
        tokens = np.unique(h, return_inverse=True)[1]
        marks = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, bool)
        laid = [np.arange(len(ids)), begins, tokens]  # of the texts that are still to be reached

        def reached(p: int, rest: np.ndarray) -> np.ndarray:
            if 2 * len(rest) < len(laid[0]):
                sizes = n[rest]
                ends = np.cumsum(sizes)
                laid[2] = tokens[np.repeat(begins[:-1][rest] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
                laid[0], laid[1] = rest, np.r_[0, ends]
            own = tokens[begins[p] : begins[p + 1]]
            marks[own] = True
            hits = np.r_[0, np.cumsum(marks[laid[2]])]
            marks[own] = False
            both = hits[laid[1][1:]] - hits[laid[1][:-1]]
            near = laid[0][alike(both, n[laid[0]], n[p], percent) & (labels[laid[0]] != labels[p])]
            return np.intersect1d(near, rest, assume_unique=True)

        a, b = searched(len(ids), reached)
        return ids[a], ids[b]

    return work


def meeting(rows: DataFrame, key: str | list[str], parts: DataFrame) -> DataFrame:
    """Rows with (p, q): those of the keys of `parts` (key, parts) are dealt into parts, each two of which meet; others have (0, 0)."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part)
    meets = F.transform(others, lambda o: F.struct(F.least(part, o).alias("p"), F.greatest(part, o).alias("q")))
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    dealt = rows.join(parts, key, "left").withColumn("_m", F.explode(F.when(F.col("parts") > 1, meets).otherwise(alone)))
    return dealt.select(*rows.columns, "_m.p", "_m.q")


def many(rows: DataFrame, key: str | list[str], weight: Column, most: int) -> DataFrame:
    """(key, parts) of the keys whose rows weigh more than `most`, in parts of half of that."""
    keys = [key] if isinstance(key, str) else key
    heavy = rows.groupBy(*keys).agg(F.sum(weight).alias("w")).where(F.col("w") > most)
    return heavy.select(*keys, F.ceil(F.col("w") / (most / 2)).cast("int").alias("parts"))


def confirmed(groups: DataFrame, texts: DataFrame, percent: int, shingle: int, tag: str) -> DataFrame:
    """Links (a, b) among the rows (g, p, q, turn, id, label, key) of each group (g, p, q), confirmed on the texts (key, text)."""
    rows = groups.join(texts, "key").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return cut(rows.select("g", "p", "q", "turn", "id", "label", "text").mapInArrow(by_group(["g", "p", "q"], confirmed_forest(percent, shingle)), "a long, b long"), tag)


def starred(stars: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Groups (g, p, q, turn, id, label, key) of texts with one other: `stars` (id, g, n) names it, n being a text's shingles.

    A star's members go in parts of `most` shingles; its centre g is sent to each part, and first.
    keys: (id, key).
    """
    parts = many(stars, "g", F.col("n"), most)
    members = stars.join(parts, "g", "left").select("g", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("p"), "id", F.lit(1).alias("turn"))
    whole = members.unionByName(members.select("g", "p").distinct().select("g", "p", F.col("g").alias("id"), F.lit(0).alias("turn")))
    return whole.join(keys, "id").select("g", "p", F.lit(0).alias("q"), "turn", "id", F.col("id").alias("label"), "key")


def texts_of(source: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    """(key, text) of `keys` (key), each once, from all rows (key, text).

    Keys grow with the rows and are never broadcast, so that the plan is one at every size.
    """
    found = source.select("key", "text").join(keys.select("key").hint("merge"), "key", "left_semi")
    return cut(found.groupBy("key").agg(F.first("text").alias("text")), tag)
