"""Whole-word abbreviations replaced in the order of a table of any size, looking only at those that occur.

The result is that of one replacement after the other, each of which sees what those before
made. A text's words say which entries can match; what an expansion brings in adds later ones.
Words that meet no entry of several words come out alike wherever they stand, and the others
depend on the few beside them only, so that each word, or group, is worked out once.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnwatch.functions import segments
from cairnwatch.functions import text as tx

_WORD = re.compile(r"\w+")
_APART = re.compile(r"(\w+)")
#: Groups of words whose outcome a task remembers, and words of the longest of them.
GROUPS, LONGEST = 100_000, 8


class Expander:
    """Replaces the abbreviations of (abbreviation, expansion) pairs, in their order, in lower-cased texts."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = [(a.lower(), e) for a, e in pairs]
        self.of_word: dict[str, list[int]] = defaultdict(list)
        other: dict[str, list[int]] = defaultdict(list)
        for i, (a, _) in enumerate(self.pairs):
            if a:
                (self.of_word if _WORD.fullmatch(a) else other)[a].append(i)
        # Entries of several words, or with signs, are looked for as parts of the text.
        self.parts = ahocorasick.Automaton() if other else None
        for a, at in other.items():
            self.parts.add_word(a, at)
        if self.parts:
            self.parts.make_automaton()
        self.pattern = lru_cache(maxsize=None)(lambda i: re.compile(rf"\b{re.escape(self.pairs[i][0])}\b"))
        # Where all entries and expansions begin and end as words do, the signs between a text's words stay as they are.
        self.apart = all(_WORD.match(s[:1]) and _WORD.match(s[-1:]) for a, e in self.pairs if a for s in (a, e))
        self.between = {s for a in other for s in _APART.split(a)[2:-1:2]}
        self.joining = self._joining(other)
        self.touched = self.of_word.keys() | self.joining
        self.outcome = lru_cache(maxsize=GROUPS)(self.ordered)

    def _joining(self, other: dict[str, list[int]]) -> set[str]:
        """Words of entries of several words, and those that expand to such, at any remove."""
        found, comes_from = {w for a in other for w in _WORD.findall(a)}, defaultdict(set)
        for w, at in self.of_word.items():
            for i in at:
                for part in _WORD.findall(self.pairs[i][1]):
                    comes_from[part].add(w)
        waiting = list(found)
        while waiting:
            new = comes_from[waiting.pop()] - found
            found |= new
            waiting.extend(new)
        return found

    def _words(self, text: str) -> set[int]:
        return {i for w in set(_WORD.findall(text)) & self.of_word.keys() for i in self.of_word[w]}

    def _parts(self, text: str) -> set[int]:
        return {i for _, at in self.parts.iter(text) for i in at} if self.parts else set()

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not self.apart:
            return self.ordered(text.lower())
        parts = _APART.split(text.lower())  # words at odd places, what stands between them at even ones
        touched, joining, between, last = self.touched, self.joining, self.between, -1
        for i in [i for i, w in enumerate(parts) if w in touched]:
            if i <= last:
                continue
            last = i
            if parts[i] in joining:
                while last + 2 < len(parts) and parts[last + 1] in between and parts[last + 2] in joining:
                    last += 2
            group = parts[i] if last == i else "".join(parts[i : last + 1])
            after = self.outcome(group) if last - i < 2 * LONGEST else self.ordered(group)
            parts[i : last + 1] = [after, *[""] * (last - i)]
        return "".join(parts)

    def ordered(self, low: str) -> str:
        """A lower-cased text with one entry after the other replaced."""
        waiting = list(self._words(low) | self._parts(low))
        heapq.heapify(waiting)
        done = -1
        while waiting:
            i = heapq.heappop(waiting)
            if i <= done:
                continue
            done = i
            abbreviation, expansion = self.pairs[i]
            after = self.pattern(i).sub(lambda _, e=expansion: e, low)
            if after == low:
                continue
            low = after
            # A replaced word has other signs on both sides, so no words but the expansion's are new.
            new = self._words(expansion) if abbreviation in self.of_word else self._words(low)
            for later in new | self._parts(low):
                if later > i:
                    heapq.heappush(waiting, later)
        return low


def expand(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """A text lower-cased, with the whole-word abbreviations of a table, which each task gets, replaced in order."""
    held: list[Expander] = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Expander(pairs))
        return texts.map(held[0], na_action="ignore")

    return run(c)


def preprocess(text: Column, content_type: Column, pairs: list[tuple[str, str]], closed: bool = False) -> Column:
    """A text cleaned by its type (html, markdown, else as it is), white space made even, abbreviations expanded, vulnerability ids in one form.

    closed: see segments.page_text.
    """
    page = segments.clean_page(F.when(content_type == "html", text), closed)
    plain = F.when(content_type == "html", page).when(content_type == "markdown", tx.clean_markdown(text)).otherwise(text)
    return tx.strip(tx.normalize_cve(expand(tx.normalize_ws(plain), pairs)))
