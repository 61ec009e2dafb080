"""One pass over a text for all keywords of a taxonomy: an Aho-Corasick automaton in Arrow batches.

The automaton is built once a task from the keyword list (a dimension of thousands of
rows), so that the plan's size doesn't depend on it and a text is read once however many
keywords there are. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx
from cairnwatch.sources.shared import small_batches

#: Fixed value: how much a signal or a contextual pattern adds to a technique's count.
SIGNAL_COUNT = 2


def grouped(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return out


def automaton(words: dict[str, tuple]):
    """Finds each of the words, wherever it stands; (end, (word, value)) for each occurrence."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in words.items():
        found.add_word(word, (word, value))
    if words:
        found.make_automaton()
    return found


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends at `start` and at `end` (exclusive), in any alphabet."""
    before = start > 0 and is_word(text[start - 1])
    after = end < len(text) and is_word(text[end])
    return before != is_word(text[start]) and after != is_word(text[end - 1])


def leftmost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that a scan from the left takes, of those that begin together the longest; they don't overlap."""
    taken, at = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            taken.append((start, end))
            at = end
    return taken


def _hits(rows: DataFrame, keys: tuple[str, ...], schema: str, start: Callable[[], Callable], columns: tuple[str, ...]) -> DataFrame:
    """Rows (keys, schema) that a matcher gives for each text; it is made once a task by `start`."""
    small_batches(rows.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, arrow = start(), None
        for batch in batches:
            at, out = [], [[] for _ in names]
            columns_ = [batch.column(c).to_pylist() for c in columns]
            for i, values in enumerate(zip(*columns_)):
                for hit in match(*values):
                    at.append(i)
                    for values_, v in zip(out, hit):
                        values_.append(v)
            kept = batch.select(list(keys)).take(pa.array(at, pa.int64()))
            arrow = arrow or [_TYPES[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(out, arrow))], [*keys, *names])

    return rows.mapInArrow(run, f"{given}, {schema}")


_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def rule_v1(
    docs: DataFrame, keywords: list[tuple[str, str]], signals: list[tuple[str, str]] = (), min_confidence: float = 0.1, keys: tuple[str, ...] = ("doc_id",), signal_keywords: dict[str, list[str]] | None = None, contexts: list[tuple[str, list[str], list[str]]] = ()
) -> DataFrame:
    """(keys, technique_id, match_count, keywords, confidence): whole-word hits, the longest of those that begin together.

    A signal phrase anywhere in the text, and a contextual pattern (technique, patterns,
    keywords), adds two to the count and its own keywords; 0.4 + 0.1 for each distinct
    keyword, 0.9 at most. A null text has no hits; keys tell a row of docs and are handed on.
    """
    words: dict[str, tuple[set, set]] = {}
    for part, pairs in enumerate((keywords, signals)):
        for technique, word in pairs:
            words.setdefault(word.lower(), (set(), set()))[part].add(technique)
    extra = signal_keywords or {}

    def start() -> Callable:
        found = automaton(words)

        def match(text: str | None, fired: list[int]) -> Iterator[tuple]:
            if not text:
                return
            low, spans, signalled = text.lower(), {}, set()
            for last, (word, (own, signal)) in found.iter(low) if words else ():
                signalled |= signal
                end = last + 1
                if own and bounded(low, end - len(word), end):
                    for t in own:
                        spans.setdefault(t, []).append((end - len(word), end))
            hits = {t: [low[s:e] for s, e in leftmost(some)] for t, some in spans.items()}
            counts = {t: len(h) for t, h in hits.items()}
            for t, more in [(t, extra.get(t, [])) for t in sorted(signalled)] + [(contexts[i][0], contexts[i][2]) for i in fired]:
                counts[t] = counts.get(t, 0) + SIGNAL_COUNT
                hits.setdefault(t, []).extend(more)
            for t, h in hits.items():
                yield t, counts[t], list(dict.fromkeys(h))

        return match

    any_of = lambda ps: reduce(lambda a, b: a | b, [F.lower("text").rlike(p) for p in ps])
    fired = F.array_compact(F.array(*[F.when(any_of(ps), F.lit(i)) for i, (_, ps, _) in enumerate(contexts)])).cast("array<int>")
    rows = _hits(docs.select(*keys, "text", fired.alias("_fired")), keys, "technique_id string, match_count int, keywords array<string>", start, ("text", "_fired"))
    confidence = F.least(F.lit(0.9), F.lit(0.4) + F.lit(0.1) * F.size("keywords"))
    return rows.withColumn("confidence", F.round(confidence, 6)).where(F.col("confidence") >= min_confidence)


def rule_v2(docs: DataFrame, keywords: list[tuple[str, str]], contexts: list[tuple[str, str, list[str]]] = (), min_confidence: float = 0.1, whole_words: bool = False) -> DataFrame:
    """Keywords of three and more letters anywhere in the text, overlapping, with context boosts and proximity.

    whole_words is the form without an automaton's positions: whole words that don't
    overlap, and no proximity. Each context pattern that occurs adds 0.2 to the boost of its
    techniques, up to 1.5; techniques without a keyword hit start from 0.8 and count the
    context's matches. A null text has no hits.
    """
    words: dict[str, set[str]] = {}
    for technique, word in keywords:
        if len(word) > 2 or whole_words:
            words.setdefault(word.lower(), set()).add(technique)

    def start() -> Callable:
        found = automaton(words)

        def match(text: str | None, near: list[list[str]]) -> Iterator[tuple]:
            if not text:
                return
            low, hits = text.lower(), {}
            for last, (word, own) in found.iter(low) if words else ():
                end = last + 1
                if not whole_words or bounded(low, end - len(word), end):
                    for t in own:
                        hits.setdefault(t, []).append((end - len(word), end))
            out = {}
            for t, spans in hits.items():
                spans = leftmost(spans) if whole_words else spans
                begins = [s for s, _ in spans]
                out[t] = [len(spans), {low[s:e]: None for s, e in spans}, 1.0, False, min(begins), max(begins), 0 if whole_words else len(spans)]
            for (_, _, techniques), seen in zip(contexts, near):
                for t in techniques if seen else ():
                    if t in out:
                        out[t][1].update(dict.fromkeys(seen))
                        out[t][2] = min(out[t][2] + 0.2, 1.5)
                    else:
                        out[t] = [len(seen), dict.fromkeys(seen), 0.8, True, None, None, 0]
            for t, (n, distinct, *rest) in out.items():
                yield t, n, list(distinct), *rest

        return match

    near = F.array(*[F.regexp_extract_all("text", F.lit(f"(?i){tx.LEFT}(?:{p})"), 0) for _, p, _ in contexts]).cast("array<array<string>>")
    schema = "technique_id string, match_count int, keywords array<string>, boost double, context_only boolean, first int, last int, n_positions int"
    rows = _hits(docs.select("doc_id", "text", near.alias("_near")), ("doc_id",), schema, start, ("text", "_near"))
    return score_v2(rows).where(F.col("confidence") >= min_confidence)


def score_v2(rows: DataFrame) -> DataFrame:
    """Confidence from distinct keywords, their repeats, the boost and how close together they lie."""
    u = F.size("keywords").cast("double")
    extra = F.when(F.col("match_count") > u, F.lit(0.05) * F.least(F.col("match_count") / F.greatest(u, F.lit(1.0)), F.lit(3.0))).otherwise(0.0)
    base = F.when(F.col("context_only"), F.lit(0.3) + F.lit(0.05) * u).otherwise(F.lit(0.4) + F.lit(0.08) * u + extra)
    score = F.least(base * F.col("boost"), F.lit(0.95))
    gap = (F.col("last") - F.col("first")) / (F.col("n_positions") - 1)
    near = (F.col("n_positions") > 1) & (gap < 100)
    score = F.when(near, F.least(score * (F.lit(1.0) + F.lit(0.1) * (F.lit(1.0) - gap / 100)), F.lit(0.95))).otherwise(score)
    return rows.withColumn("confidence", F.round(score, 6))


def mentions(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, entity, entity_type) of listed terms in a text: a rule-based tagger."""
    words: dict[str, list[tuple[str, str]]] = {}
    for entity, kind in terms:
        words.setdefault(entity.lower(), []).append((entity, kind))

    def start() -> Callable:
        found = automaton(words)

        def match(text: str | None) -> Iterator[tuple]:
            if text and words:
                for pairs in {word: pairs for _, (word, pairs) in found.iter(text.lower())}.values():
                    yield from pairs

        return match

    return _hits(docs.select("doc_id", "text"), ("doc_id",), "entity string, entity_type string", start, ("text",))


def overlaps(words: list[str], others: list[str]) -> list[tuple[str, str]]:
    """(word, other) where one contains the other, of two dimension lists; case ignored."""
    out = set()
    for few, many, turn in ((words, others, False), (others, words, True)):
        by = {}
        for w in few:
            by.setdefault(w.lower(), []).append(w)
        found = automaton({w: tuple(ws) for w, ws in by.items()})
        for text in many if by else ():
            for _, (_, ws) in found.iter(text.lower()):
                out |= {(text, w) if turn else (w, text) for w in ws}
    return sorted(out)
