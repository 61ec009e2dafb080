"""Periodic runs of words: block matching with an Aho-Corasick automaton over integer sequences.

A run with period q is a maximal stretch in which words q apart are identical. Let B be the
power of two with B <= q < 2 B: a run of four periods holds a block of B words that begins
at a multiple of B, and the same block again q words later. At each scale B, the aligned
blocks of a document are the keys of an automaton that is searched across the document; an
occurrence B to 2 B - 1 words behind its block is a seed, which is extended word by word in
both directions. Scales are searched from small to large, so that a stretch whose run is
known is not searched again under a multiple of its period.

Most words can't lie in any run: a run's grams (of min(B, 8) words) each return within 2 B
words, over more than 2 B positions in a row. Only such stretches are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnwatch.llm.common import id_text, slices

#: A run has this many words and this many periods at least. Four is also the least that the seeds' argument needs.
LEAST, PERIODS = 6, 4
#: Words of the longest gram by which stretches are chosen.
GRAM = 8

Run = tuple[int, int, int]


def _again(ids: np.ndarray) -> np.ndarray:
    """Distance from each position to the next one with the same number; the array's length where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _paired(ids: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the grams that begin with gram i and go on with gram i + step; equal only for equal grams."""
    if len(ids) <= step:
        return np.zeros(0, np.int64)
    both = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
    return np.unique(both, return_inverse=True)[1].astype(np.int64)


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs of true flags that are `least` long or longer."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return [(b, e) for b, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - b >= least]


def _seeds(words: np.ndarray, begin: int, end: int, block: int) -> list[tuple[int, int]]:
    """(start of an aligned block, distance) of its occurrences block to 2 * block - 1 words behind, within words[begin:end]."""
    starts = range(-(-begin // block) * block, end - block + 1, block)
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    of = [number.setdefault(tuple(words[s : s + block].tolist()), len(number)) for s in starts]
    if not of:
        return []
    for key, n in number.items():
        keys.add_word(key, n)
    keys.make_automaton()
    seeds = []
    for last, n in keys.iter(tuple(words[begin:end].tolist())):
        at = begin + last - block + 1
        own = (at - block) // block  # the only aligned block at such a distance before
        s = own * block
        own -= starts[0] // block
        if own >= 0 and of[own] == n:
            seeds.append((s, at - s))
    return seeds


def _extended(words: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The largest stretch (start, end) around a seed in which words `distance` apart are identical."""
    right, step, n = at, 64, len(words)
    while right + distance < n:
        upto = min(right + step, n - distance)
        differ = words[right:upto] != words[right + distance : upto + distance]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = upto, 2 * step
    left, step = at, 64
    while left > 0:
        down = max(0, left - step)
        differ = (words[down:left] != words[down + distance : left + distance])[::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left, step = down, 2 * step
    return left, right + distance


def runs(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period.

    A run has the smallest period possible, max(least, periods * period) words or more, and
    no neighbouring word extends it. periods: 4 or more.
    """
    if periods < 4:
        raise ValueError("blocks are sure to seed runs of four periods or more only")
    n, found, whole = len(words), [], set()
    grams = words.astype(np.int64)
    gram, block = 1, 1
    again = None
    while periods * block <= n:
        if block <= GRAM:
            if block > 1:
                grams = _paired(grams, gram)
                gram = block
            again = _again(grams)
        near = again < 2 * block
        ends: dict[int, int] = {}  # how far each distance has been extended
        for b, e in _stretches(near, 2 * block + 1):
            upto = min(n, e + gram)
            if any(start <= b and upto <= start + length for start, length, _ in found):
                continue
            for s, d in _seeds(words, b, upto, block):
                if s + block <= ends.get(d, 0):
                    continue
                start, end = _extended(words, s, d)
                ends[d] = end - d
                if end - start >= max(least, periods * d) and (start, end) not in whole:
                    whole.add((start, end))
                    found.append((start, end - start, d))
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, found: list[Run]) -> np.ndarray:
    """Flags of the words that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, all_runs, kept = [], [], []
            for text in part.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = runs(numbered(words), least, periods)
                if found:
                    gone = dropped(len(words), found)
                    words_kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    words_kept = words
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(words_kept).decode("utf-8", "replace"))
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    Words are divided by ASCII whitespace and compared as they are. runs: (start, length,
    period) of each, by start, then period; collapsed: the words outside runs and the first
    period of each, joined by a space. Null and empty texts have no words, no runs and an
    empty collapsed text. Nothing is shuffled: rows that repeat or tie each give a row, a
    null id stays null, other columns are not read, an empty table gives an empty result.
    A text is worked on whole, at about 100 bytes a word.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_found(least, periods), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
