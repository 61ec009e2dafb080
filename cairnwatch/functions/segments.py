"""Texts into segments and chunks: greedy folds over sentences, linear in the text, in Arrow batches.

A fold carries what it has packed so far, which Column functions could only do by copying
it at each step; so these are plain Python functions, and Arrow-batched UDFs of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Where a chunk would rather end, in order of preference.
BOUNDARIES = ["\n\n", "\n", ". ", "! ", "? ", "; ", ":", " - ", "--"]


def by_paragraph(text: str | None, most: int = 1000) -> list[str]:
    """Paragraphs as they are; longer ones than `most` packed from sentences while the sum stays below it."""
    out = []
    for p in (text or "").split("\n\n"):
        if not p.strip():
            continue
        if len(p) <= most:
            out.append(p)
            continue
        now = ""
        for s in _SENTENCE.split(p):
            if len(now) + len(s) < most:
                now += s + " "
            else:
                out.append(now.strip())
                now = s + " "
        out.append(now.strip())
    return out


def by_line(text: str | None, most: int = 2048) -> list[str]:
    """Lines joined by spaces up to `most` characters; longer lines are packed from their sentences."""
    out, now = [], ""
    for line in filter(None, (x.strip() for x in (text or "").split("\n"))):
        if len(line) > most:
            if now:
                out.append(now)
            now, units = "", _SENTENCE.split(line)
        else:
            units = [line]
        for u in units:
            if now and len(now) + len(u) > most:
                out.append(now)
                now = u
            else:
                now = f"{now} {u}" if now else u
    return [*out, now] if now else out


def chunk_spans(text: str | None, size: int = 5000, overlap: int = 500, threshold: int = 25_000) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks that end at a boundary near their end; a short text is one chunk.

    All boundaries of the text are found at once, by preference; a chunk's end is then looked
    up by bisection: of the first kind that lies in its last quarter (500 characters at most),
    the last one.
    """
    text = text or ""
    if len(text) <= threshold:
        return [(0, len(text))]
    places = [(len(b), [m.start() for m in re.finditer(f"(?={re.escape(b)})", text)]) for b in BOUNDARIES]
    reach = min(500, size // 4)

    def end_of(start: int) -> int:
        latest = start + size
        if latest >= len(text):
            return len(text)
        for wide, starts in places:
            upto = bisect_right(starts, latest - wide)
            if upto and starts[upto - 1] > latest - reach:
                return starts[upto - 1] + wide
        return latest

    spans: list[tuple[int, int]] = []
    start = 0
    while start < len(text):
        spans.append((start, end_of(start)))
        back = spans[-1][1] - overlap
        start = back if back > start else spans[-1][1]
    return spans


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


#: An ampersand that doesn't begin the number of a character, and the name after it up to its semicolon.
_NAMED = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


def page_text(html: str | None, closed: bool = False) -> str:
    """Text of a page, entities resolved, without scripts and styles; phrases stripped, one a line.

    closed: whether only entities with their semicolon are resolved; browsers also take some without.
    """
    parser = _Text()
    html = html or ""
    parser.feed(_NAMED.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), html) if closed else html)
    parser.close()
    phrases = (p.strip() for line in "".join(parser.parts).splitlines() for p in line.strip().split("  "))
    return "\n".join(p for p in phrases if p)


def paragraph_segments(c: Column, most: int = 1000) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: by_paragraph(t, most)), "array<string>")(c)


def line_segments(c: Column, most: int = 2048) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: by_line(t, most)), "array<string>")(c)


def snapped_chunks(c: Column, size: int = 5000, overlap: int = 500, threshold: int = 25_000) -> Column:
    """Array of (chunk_id, start, end, text)."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(i, s, e, (t or "")[s:e]) for i, (s, e) in enumerate(chunk_spans(t, size, overlap, threshold))])

    schema = "array<struct<chunk_id: int, start: long, end: long, text: string>>"
    rows = F.pandas_udf(lambda s: cut(s).map(lambda r: [dict(zip(("chunk_id", "start", "end", "text"), x)) for x in r]), schema)
    return rows(c)


def clean_page(c: Column, closed: bool = False) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: page_text(t, closed)), "string")(c)
