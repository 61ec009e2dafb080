"""Secret scans: fixed patterns, and credential-context values judged by password guess cost.

The cost of a value is the least log10 of guesses over all its segmentations into
dictionary words, dates, repeats, keyboard walks or sequences, and brute-force spans, found
by dynamic programming over its characters; any part of a walk, sequence or repeat may be a
segment, not the longest alone. Words rank by a short list of common choices and then by the
pieces of a public tokenizer's vocabulary, which lists them by frequency. A value next to a credential word that no
attacker would soon guess is reported as a secret of kind `guess`; placeholders such as
`changeme123` cost too little.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnwatch.llm.common import slices

ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more are what is left of [0-9a-f]+ once shorter ones are dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?ia)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client)[_-]?(?:key|secret))["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(["']?)([^\s"'<>]+)"""
)
#: In lower case; a text without any of these has no assign or context match.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")
KINDS = ("assign", "access", "hex", "guess")

#: Common choices by rank, most common first (public lists of leaked passwords and plain words).
COMMON = """password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football
shadow superman batman trustno1 secret root test guest changeme default example user hello freedom whatever charlie
michael jordan baseball access hunter ranger buster soccer hockey killer george andrew thomas jessica pepper daniel
summer winter spring autumn january monday love money token pass key api placeholder dummy sample demo temp null none
true false your my the here insert value string xxxx todo redacted hidden service server database mysql postgres
oracle system manager support public private internal prod production staging develop local cloud backup""".split()
#: A vocabulary file whose pieces that are a space and letters are words, most common first.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEET = str.maketrans("@431!05$7", "aaeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-/._ ]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._ ]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")
DATE_CHARS = (4, 10)


@functools.cache
def ranks(vocabulary: str | None = VOCABULARY) -> dict[str, int]:
    """Rank of each known word, in lower case; the short list alone without a vocabulary."""
    words = dict.fromkeys(COMMON)
    if vocabulary:
        with open(vocabulary, "rb") as f:
            for line in f:
                piece = base64.b64decode(line.split()[0])
                if len(piece) > 3 and piece[:1] == b" " and piece[1:].isalpha() and piece.isascii():
                    words.setdefault(piece[1:].decode().lower())
    return {w: i + 1 for i, w in enumerate(words)}


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on a staggered keyboard, from its rows."""
    place = {c: (r, i + r * 0.5) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {a: {b for b, (s, y) in place.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1} for a, (r, x) in place.items()}


NEAR = _neighbours()
STEP = math.log10(2)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 4.0


def lowered(value: str) -> str:
    """The value in lower case, character for character."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def word_cost(piece: str, words: dict[str, int]) -> float | None:
    """log10 guesses of a dictionary word, with capitals and common substitutions; None for another piece."""
    low = lowered(piece)
    rank = words.get(low)
    leet = 0.0
    if rank is None:
        rank, leet = words.get(low.translate(LEET)), 2 * STEP
    if rank is None:
        return None
    upper = sum(c.isupper() for c in piece)
    return math.log10(rank + 1) + (0.0 if not upper else STEP if upper in (1, len(piece)) else upper * STEP) + leet


def date_cost(piece: str) -> float | None:
    """log10 guesses of a date, or of a year; None for another piece."""
    m = DATE.fullmatch(piece)
    return None if m is None else math.log10(100 if len(piece) == 4 else 36_500) + (0.5 if m[1] or m[2] else 0)


class _Run:
    """Least cost of a segment that ends here and is any part of a run, of `least` characters or more.

    A part from i to j costs fixed + log10(j - i) + upto[j] - since[i]. A start stays only
    while no start before it does as well: log10 grows ever slower, so a start that has
    fallen behind an earlier one never comes back, and few remain.
    """

    def __init__(self, kind: str, least: int) -> None:
        self.kind, self.least, self.begin, self.starts = kind, least, 0, []

    def reset(self, begin: int) -> None:
        self.begin, self.starts = begin, []

    def ending(self, j: int, best: list[float], since: list[float], upto: list[float], fixed: float) -> tuple[float, int, str] | None:
        i = j - self.least
        if i < self.begin:
            return None
        self.starts.append((best[i] - since[i], i))
        least, kept = None, []
        for key, i in self.starts:
            cost = key + math.log10(j - i)
            if least is None or cost < least[0]:
                least = (cost, i)
                kept.append((key, i))
        self.starts = kept
        return least[0] + fixed + upto[j], least[1], self.kind


def guess_cost(value: str, vocabulary: str | None = VOCABULARY) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 of guesses for a value, with the segmentation that reaches it.

    Every segment costs a factor of two besides, so that many small pieces don't win by
    themselves; brute-force characters next to each other are one segment.
    """
    n, words = len(value), ranks(vocabulary)
    longest = max(map(len, words))
    low, inf = lowered(value), float("inf")
    chars = [_char_cost(c) for c in value]
    best = [0.0] + [inf] * n  # whatever the last segment is
    brute = [inf] * (n + 1)  # the last segment is brute force
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    opened = [0] * (n + 1)
    level, turned = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):  # each change of a walk's direction costs a factor of two
        bend = j > 2 and ord(low[j - 1]) - ord(low[j - 2]) != ord(low[j - 2]) - ord(low[j - 3])
        turned[j] = turned[j - 1] + (STEP if bend else 0.0)
    # A part from i has no turn before its third character.
    after = [turned[min(i + 2, n)] for i in range(n + 1)]
    walk, up, down = _Run("walk", 3), _Run("sequence", 3), _Run("sequence", 3)
    repeats = [(w, _Run("repeat", max(3, 2 * w))) for w in range(1, 9)]
    unit = [0.0] * 9
    for j in range(1, n + 1):
        c, a, z = chars[j - 1], low[j - 2] if j > 1 else "", low[j - 1]
        fresh, longer = best[j - 1] + STEP + c, brute[j - 1] + c
        brute[j], opened[j] = (longer, opened[j - 1]) if longer <= fresh else (fresh, j - 1)
        best[j], back[j] = brute[j], (opened[j], "brute")
        found = [(best[i] + cost, i, "word") for i in range(max(0, j - longest), j - 2) if (cost := word_cost(value[i:j], words)) is not None]
        if value[j - 1].isdigit():
            found += [(best[i] + cost, i, "date") for i in range(max(0, j - DATE_CHARS[1]), j - DATE_CHARS[0] + 1) if value[i].isdigit() and (cost := date_cost(value[i:j])) is not None]
        step = ord(z) - ord(a) if a and a.isalnum() else 0
        ends = []
        for run, follows, guesses, since, upto in ((walk, z in NEAR.get(a, ()), 47 * 4, after, turned), (up, step == 1, 26 * 2, level, level), (down, step == -1, 26 * 4, level, level)):
            if follows:
                ends.append(run.ending(j, best, since, upto, math.log10(guesses)))
            else:
                run.reset(j - 1)
        for w, run in repeats:
            unit[w] += c - (chars[j - 1 - w] if j > w else 0.0)
            if j > w and value[j - 1] != value[j - 1 - w]:
                run.reset(j - w)
            elif j > w:
                ends.append(run.ending(j, best, level, level, unit[w] - math.log10(w)))
        found += [e for e in ends if e is not None]
        for cost, i, kind in found:
            if cost + STEP < best[j]:
                best[j], back[j] = cost + STEP, (i, kind)
    path, i = [], n
    while i:
        s, kind = back[i]
        path.append((s, i, kind))
        i = s
    return best[n], path[::-1]


def base_spans(text: str, hinted: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' whole matches, code points, end exclusive."""
    found = []
    if hinted:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guessed_spans(text: str, least_cost: float = 8.0, least_chars: int = 6, vocabulary: str | None = VOCABULARY) -> list[tuple[int, int, str, float]]:
    """(start, end, 'guess', cost) of credential-context values that cost 10**least_cost guesses or more."""
    found = []
    for m in CONTEXT.finditer(text):
        value = m[2] if m[1] else m[2].rstrip(".,;:!?)]}")
        if len(value) >= least_chars and (cost := guess_cost(value, vocabulary)[0]) >= least_cost:
            found.append((m.start(2), m.start(2) + len(value), "guess", cost))
    return found


def joined(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, costs array<double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 8.0, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """A row for each row of docs with its secrets (SCHEMA); spans is `kind:start:end`, comma-joined.

    base_sha256 digests the fixed patterns' spans alone; costs are the log10 guesses of the
    `guess` spans in order of start. A null text is empty, an empty text has no spans, long
    texts are scanned whole, repeated rows and null ids are rows like any other; an empty
    table gives an empty result. Columns beyond id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "costs")}
            for text in part.column("text").to_pylist():
                text = text or ""
                low = text.lower()
                hinted = any(h in low for h in HINTS)
                base = base_spans(text, hinted)
                guessed = guessed_spans(text, least_cost, vocabulary=vocabulary) if hinted else []
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined([*base, *guessed]))
                out["n_guess"].append(len(guessed))
                out["costs"].append([round(s[3], 3) for s in guessed])
            arrays = [part.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["n_guess"], pa.int64()), pa.array(out["costs"], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "costs"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
