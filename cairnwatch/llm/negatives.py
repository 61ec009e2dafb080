"""Hard negatives by bit-sliced integer products.

Vectors are integers; a row's score is its inner product with an anchor. The rows' components
are cut into bit planes, the most significant (the sign) first. With the planes above bit t
known, what is missing of each component lies between 0 and 2**t - 1, so a score lies within

    known + (sum of the anchor's negative components) * (2**t - 1)  and
    known + (sum of its positive components) * (2**t - 1).

Each plane halves these intervals; pairs whose interval cannot qualify any more are dropped,
and the last plane leaves exact scores. Anchors meet all rows in blocks of either; a block
pair hands on only the few best for each anchor, and those of all blocks are ranked at last.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.llm.common import cut, tidy

#: Anchors and rows of one block pair, and rows that are scored at a time; they bound a task's memory.
ANCHORS, ROWS, CHUNK = 1024, 8192, 1024
#: Quantised components are held between -2**24 and 2**24 - 1, so that scores of up to 16,384 components fit a long.
COMPONENT_BITS = 24
#: Pairs are followed one by one once fewer than this part of a block's pairs is left.
SPARSE = 1 / 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, held within COMPONENT_BITS bits and sign; null if any is null or not finite."""
    most = 1 << COMPONENT_BITS
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(wide, lambda x: F.least(F.greatest(F.floor(scale * F.greatest(F.least(x, F.lit(float(most))), F.lit(float(-most)))), F.lit(-most)), F.lit(most - 1)).cast("int"))
    return F.when(vector.isNotNull() & ~odd, whole)


Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sliced(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that `rule` leaves; both sides are matrices of whole numbers.

    alive: which pairs take part at all. rule(lo, hi, alive) says, for lo <= score <= hi, which
    may still qualify; it is asked after each plane. Products are of whole numbers below 2**53
    and so exact in doubles. Once few pairs are left each is followed by itself.
    """
    planes = int(max(1, max((int(np.abs(rows + (rows < 0)).max()) if rows.size else 0).bit_length(), 1)))
    wide = anchors.astype(np.float64)
    up, down = np.maximum(wide, 0).sum(1), np.minimum(wide, 0).sum(1)
    # Two's complement: the sign plane weighs -2**planes, the others 2**t.
    known = -float(1 << planes) * (wide @ (rows < 0).T.astype(np.float64))
    width = float((1 << planes) - 1)
    alive = alive & rule(known + down[:, None] * width, known + up[:, None] * width, alive)
    t = planes - 1
    while t >= 0 and alive.sum() > SPARSE * alive.size:
        known += float(1 << t) * (wide @ ((rows >> t) & 1).T.astype(np.float64))
        width = float((1 << t) - 1)
        alive &= rule(known + down[:, None] * width, known + up[:, None] * width, alive)
        t -= 1
    a, r = np.nonzero(alive)
    score = known[a, r]
    while t >= 0 and len(a):
        for at in range(0, len(a), 1 << 15):
            part = slice(at, at + (1 << 15))
            score[part] += float(1 << t) * np.einsum("ij,ij->i", wide[a[part]], ((rows[r[part]] >> t) & 1).astype(np.float64))
        width = float((1 << t) - 1)
        lo, hi, own = np.full(alive.shape, np.nan), np.full(alive.shape, np.nan), np.zeros(alive.shape, bool)
        lo[a, r], hi[a, r], own[a, r] = score + down[a] * width, score + up[a] * width, True
        keep = rule(lo, hi, own)[a, r]
        a, r, score = a[keep], r[keep], score[keep]
        t -= 1
    return a, r, score.astype(np.int64)


def _nth_best(lo: np.ndarray, sure: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row's sure lower bounds, as a column; minus infinity with fewer."""
    out = np.full((len(lo), 1), -np.inf)
    enough = np.flatnonzero(np.count_nonzero(sure, axis=1) >= n)
    if len(enough):
        held = np.where(sure[enough], lo[enough], -np.inf)
        out[enough, 0] = np.partition(held, lo.shape[1] - n, axis=1)[:, lo.shape[1] - n]
    return out


def best_rule(n: int) -> Rule:
    """Pairs that may be among the n best of their anchor; ties stay."""

    def rule(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return alive & (hi >= _nth_best(lo, alive, n))

    return rule


def window_rule(least: np.ndarray, most: np.ndarray, n: int) -> Rule:
    """Pairs that may be among the n best within any of their anchor's windows (least, most: anchors x windows; NaN: none)."""

    def rule(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
        keep = np.zeros(alive.shape, bool)
        for w in range(least.shape[1]):
            begin, end = least[:, w, None], most[:, w, None]
            possible = alive & (hi >= begin) & (lo <= end)
            sure = possible & (lo >= begin) & (hi <= end)
            keep |= possible & (hi >= _nth_best(lo, sure, n))
        return keep

    return rule


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; missing components of shorter ones are 0."""
    vectors = column.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(vectors.flatten(), np.int64)
    return out


def _ordered(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of vec_ids in order, null last; equal ids share a place."""
    known = ids.combine_chunks()
    values = np.asarray(known.fill_null(0), np.int64)
    _, place = np.unique(values, return_inverse=True)
    return np.where(np.asarray(known.is_null()), len(values), place)


def _width(*tables: pa.Table) -> int:
    return max(int(np.asarray(t.column("q").combine_chunks().value_lengths().fill_null(0)).max()) for t in tables)


def _empty(columns: list[str]) -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in columns})


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Indices of each group's first n by falling score, ties by place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.r_[begins, len(g)]))
    return order[rank < n]


_BEST = ["anchor", "anchor_id", "vec_id", "uid", "score"]
_FOUND = ["anchor", "place", "vec_id", "uid", "score"]


def _positives(n: int):
    """The n best rows of an anchor's own label in a block pair, its own row left out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(_BEST)
        width = _width(left, right)
        a, b = _matrix(left.column("q"), width), _matrix(right.column("q"), width)
        labels, of = (np.asarray(t.column("label"), np.int64) for t in (left, right))
        uid, own = (np.asarray(t.column("uid"), np.int64) for t in (left, right))
        found = []
        for label in np.unique(labels):
            x, y = np.flatnonzero(labels == label), np.flatnonzero(of == label)
            for at in range(0, len(y), CHUNK):
                part = y[at : at + CHUNK]
                i, j, s = sliced(a[x], b[part], uid[x][:, None] != own[part][None, :], best_rule(n))
                found.append(np.stack([x[i], part[j], s]))
        i, j, s = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        first = _first(i, s, _ordered(right.column("vec_id"))[j], n)
        i, j, s = i[first], j[first], s[first]
        take_left, take_right = left.take(pa.array(i)), right.take(pa.array(j))
        columns = [take_left.column("uid"), take_left.column("vec_id"), take_right.column("vec_id"), take_right.column("uid"), pa.array(s, pa.int64())]
        return pa.table(columns, _BEST)

    return run


def _negatives(n: int, low: int, high: int):
    """The n best rows of other labels within each positive's window, in a block pair."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(_FOUND)
        width = _width(left, right)
        a, b = _matrix(left.column("q"), width), _matrix(right.column("q"), width)
        labels, of = (np.asarray(t.column("label"), np.int64) for t in (left, right))
        positives = left.column("positives").combine_chunks()
        counts = np.asarray(positives.value_lengths().fill_null(0), np.int64)
        scores = np.full((len(a), int(counts.max()) if len(counts) else 0), np.nan)
        scores[np.arange(scores.shape[1])[None, :] < counts[:, None]] = np.asarray(positives.flatten(), np.float64)
        # low * p <= 100 * s <= high * p for whole s.
        least, most = -np.floor(-low * scores / 100), np.floor(high * scores / 100)
        place, found = _ordered(right.column("vec_id")), []
        for at in range(0, len(b), CHUNK):
            part = np.arange(at, min(at + CHUNK, len(b)))
            i, j, s = sliced(a, b[part], labels[:, None] != of[part][None, :], window_rule(least, most, n))
            found.append(np.stack([i, part[j], s]))
        i, j, s = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        out = []
        for w in range(scores.shape[1]):
            within = np.flatnonzero((s >= least[i, w]) & (s <= most[i, w]))
            first = within[_first(i[within], s[within], place[j[within]], n)]
            out.append(np.stack([i[first], np.full(len(first), w), j[first], s[first]]))
        i, w, j, s = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((4, 0), np.int64)
        columns = [left.column("uid").take(pa.array(i)), pa.array(w + 1, pa.int64()), right.column("vec_id").take(pa.array(j)), right.column("uid").take(pa.array(j)), pa.array(s, pa.int64())]
        return pa.table(columns, _FOUND)

    return run


def _block_pairs(anchors: DataFrame, rows: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], columns: list[str]) -> DataFrame:
    """What `meet` finds in each pair of an anchor block and a row block."""
    a_blocks, r_blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((anchors, ANCHORS), (rows, ROWS)))
    # The uid's hash deals rows of any label or id evenly.
    left = anchors.withColumn("a", F.pmod(F.xxhash64("uid"), F.lit(a_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))
    right = rows.withColumn("r", F.pmod(F.xxhash64("uid"), F.lit(r_blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(meet, ", ".join(f"{c} long" for c in columns))


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


@tidy
def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's positives.

    anchor: which rows of `vectors` are anchors (null: not); label: the label they get
    (label_col itself by default). An anchor's positives are its `positives` best other rows of
    its label; each gets the `negatives` best rows of another label whose score s holds
    low * p <= 100 * s <= high * p for the positive's score p. Scores are integer inner
    products of floor(scale * x); higher first, ties by smaller id, null ids last.

    Rows with a null label, a null vector, or a null or non-finite component take no part; so
    do anchors without positives and positives without negatives. Shorter vectors have zeros
    where they end, an empty one is all zeros; components beyond 2**24 after scaling are held
    there. Rows that repeat an id or all columns are rows of their own, of which each that is
    an anchor gets its own results. Further columns are not read, and an empty table gives an
    empty result. Every row meets every anchor, in blocks: each row is sent once for each
    ANCHORS anchors.
    """
    label = F.col(label_col) if label is None else label
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), quantised(F.col(vector_col), scale).alias("q"))
    rows = cut(picked.where(F.col("label").isNotNull() & F.col("q").isNotNull()).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    base, asked = rows.select("uid", "vec_id", "label", "q"), rows.where("anchor").select("uid", "vec_id", "label", "q")
    best = _ranked(_block_pairs(asked, base, _positives(positives), _BEST), ["anchor"], positives)
    best = cut(best.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("place")), "negatives-positives")
    scores = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    ready = cut(asked.join(scores, asked["uid"] == scores["anchor"]).select("uid", "label", "q", "positives"), "negatives-asked")
    found = _block_pairs(ready, base, _negatives(negatives, low, high), _FOUND)
    ranked = _ranked(found, ["anchor", "place"], negatives)
    return ranked.join(best, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
