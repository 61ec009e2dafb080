"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the bounded (Fermi-Dirac) entropy from one copy each, subject
to a token constraint for every source; the dual is convex, one multiplier a source, and
the rates are exponential tilts exp(lambda * tokens) bent so that none exceeds the cap.
Newton steps are distributed: a rate depends only on source and size, so the histogram
of sizes holds all a step needs, and each step is one partial aggregation over it. Rates
are rounded into copies by error diffusion from the longest document to the shortest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.llm.common import cut, discard, keyed_rows, row_key, tidy

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that one rounding group holds, about.
GROUP_ROWS = 4000


def source_key(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _sizes(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), source_key(F.col("source")).alias("source_key"), size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source_key, source_size, target) of (source_key, source_size, n) rows, one a source.

    Sources by code point, null last, take the weights in turn. They share all tokens by
    weight; a target stops at cap times its source's size and the excess is shared again
    by weight among the others until none is above.
    """
    order = W.orderBy(F.col("source_key") == "-", "source_key")  # one row a source
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = cut(sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))), "mix-sources")
    level, full = None, F.lit(False)
    while True:
        s = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size") * cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        if level is not None and s["n"] == held or not s["open"]:
            break
        held = s["n"]
        level = ((s["all"] or 0) - (s["held"] or 0)) / s["open"]
        full = F.col("weight") * level > F.col("source_size") * cap
    capped = F.col("source_size") * F.lit(float(cap))
    return rows.withColumn("target", F.when(full, capped).otherwise(F.col("weight") * (level or 0.0))).drop("weight")


def _rate(lam: Column, size: Column, scale: Column, cap: float) -> Column:
    """cap * e^x / (cap - 1 + e^x) with x = lam * size / scale, written so that it can't overflow."""
    x = lam * size / scale
    return F.when(x > 0, cap / ((cap - 1) * F.exp(-x) + 1)).otherwise(cap * F.exp(x) / (cap - 1 + F.exp(x)))


def solve(hist: DataFrame, sources: DataFrame, cap: float = 3.0, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """Adds `lam` and `scale` to sources so that the rates over hist (source_key, size, n) meet the targets.

    A source at its cap, or of no tokens, needs no multiplier: lam is infinite or 0.
    """
    moments = hist.groupBy("source_key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    state = sources.join(moments, "source_key").withColumn("scale", F.greatest("scale", F.lit(1.0)))
    at_cap = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = state.withColumn("done", at_cap | (F.col("source_size") == 0))
    state = state.withColumn("lam", F.when(F.col("source_size") == 0, 0.0).when(at_cap, float("inf")).otherwise(0.0))
    state = cut(state.withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf"))), "mix-state")
    for _ in range(most_steps):
        if state.where(~F.col("done")).isEmpty():
            return state.drop("done", "lo", "hi")
        joined = hist.join(state.where(~F.col("done")).select("source_key", "lam", "scale"), "source_key")
        r = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        slope = r * (1 - r / cap) * F.col("size") / F.col("scale")
        sums = joined.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size") * r).alias("g"), F.sum(F.col("n") * F.col("size") * slope).alias("h"))
        after = state.join(sums, "source_key", "left")
        lo = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        after = after.withColumn("lo2", lo).withColumn("hi2", hi)
        # A step is held to twice the distance from 1, and to the bracket: half of it where Newton leaves it.
        reach = 2 * (F.abs("lam") + 1)
        newton = F.col("lam") + F.greatest(-reach, F.least(reach, (F.col("target") - F.col("g")) / F.greatest("h", F.lit(1e-300))))
        outside = (newton <= F.col("lo2")) | (newton >= F.col("hi2"))
        step = F.when(outside, (F.col("lo2") + F.col("hi2")) / 2).otherwise(newton)
        close = F.abs(F.col("g") - F.col("target")) <= tolerance * F.greatest("target", F.lit(1.0))
        after = after.withColumn("done2", F.col("done") | close).withColumn("lam", F.when(F.col("done2"), F.col("lam")).otherwise(step))
        after = cut(after.select("source_key", "source_size", "n", "target", "scale", F.col("done2").alias("done"), "lam", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi")), "mix-state")
        discard(state)
        state = after
    raise RuntimeError("entropy balancing did not settle")


def _closed(words: np.ndarray, copies: np.ndarray, left: float, cap: int) -> np.ndarray:
    """Takes one copy more or less of one or two documents at a time that bring the words left over closest to none.

    Two moves are found by sorting: for each move the nearest partner of what it leaves.
    """
    n = len(words)
    while True:
        moves = np.concatenate([np.where(copies < cap, words, 0), np.where(copies > 0, -words, 0)])
        order = np.argsort(moves, kind="stable")
        ranked = moves[order]
        gap, chosen = abs(left) - 1e-6, []
        best = int(np.argmin(np.abs(left - moves)))
        if abs(left - moves[best]) < gap:
            gap, chosen = abs(left - moves[best]), [best]
        at = np.searchsorted(ranked, left - moves)
        for near in (at - 1, at):
            near = np.clip(near, 0, 2 * n - 1)
            rest = np.where(order[near] % n == np.arange(2 * n) % n, np.inf, np.abs(left - moves - ranked[near]))
            i = int(np.argmin(rest))
            if rest[i] < gap - 1e-6:
                gap, chosen = rest[i], [i, int(order[near[i]])]
        if not chosen:
            return copies
        for m in chosen:
            left -= moves[m]
            copies[m % n] += 1 if m < n else -1


def _diffused(cap: int):
    """Copies of one group: rates rounded, each error handed on to the next shorter document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        words = (pdf["size"] * pdf["times"]).tolist()
        copies, carry = [], 0.0
        for r, w in zip(pdf["rate"].tolist(), words):
            n = min(cap, max(0, int(np.floor(r + (carry / w if w else 0.0) + 0.5))))
            carry += (r - n) * w
            copies.append(n)
        pdf["copies"] = _closed(np.array(words, np.int64), np.array(copies, np.int64), carry, cap)
        return pdf[["key", "source_key", "copies"]]

    return run


@tidy
def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, key, source_key, size, source_size, target, rate, copies) for each row of docs.

    size counts runs outside \\x20 and \\x09-\\x0D (null text: 0). Rows that repeat id, text
    and source share their copies. A null source is a source of its own and the last. A
    document without words keeps one copy, or its source's capped number. An empty table
    gives an empty plan; further columns are not read. The same rows give the same plan.
    """
    rows = cut(_sizes(docs), "mix-sizes")
    hist = cut(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sizes = hist.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    sources = solve(hist, targets(sizes, weights, cap), cap)
    sources = cut(sources, "mix-solved")
    distinct = rows.groupBy("key", "source_key", "size").agg(F.count(F.lit(1)).alias("times"))
    r = F.when(F.col("lam") == float("inf"), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("scale"), cap))
    rated = distinct.join(sources, "source_key").withColumn("rate", r)
    groups = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.lit(1))
    rated = rated.withColumn("part", F.pmod(F.xxhash64("key"), groups)).select("key", "source_key", "size", "times", "rate", "part")
    copies = cut(rated.groupBy("source_key", "part").applyInPandas(_diffused(cap), "key binary, source_key string, copies long"), "mix-copies")
    found = rows.join(copies, ["key", "source_key"]).join(sources.select("source_key", "source_size", "target", "lam", "scale"), "source_key")
    return found.select("doc_id", "key", "source_key", "size", "source_size", "target", r.alias("rate"), "copies")


@tidy
def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """docs with each row repeated as often as the plan says; all columns are kept, whatever their names.

    Null sources, null and empty texts, ties and repeated rows are taken as in plan(); a
    document without words keeps one copy, or its source's capped number; an empty table
    stays empty.
    """
    copies = plan(docs, weights, cap).where("copies > 0").select("key", "source_key", "copies").distinct()
    keyed = keyed_rows(docs).withColumn("source_key", source_key(F.col("row.source")))
    joined = keyed.join(cut(copies, "mix-taken"), ["key", "source_key"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
