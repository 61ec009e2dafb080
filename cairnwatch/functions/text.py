"""Column functions over texts: cleaning, chunking, parsing, hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore of any alphabet, and white space of any kind.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = SPACE + "+"
LEFT, RIGHT = rf"(?<!{WORD})", rf"(?!{WORD})"
_META = set(r".^$*+?{}[]\|()-&")


def escape(s: str) -> str:
    return "".join("\\" + c if c in _META else c for c in s)


def word_pattern(keywords: list[str], java: bool = True) -> str:
    """One pattern for whole keywords, longest first, case ignored."""
    body = "|".join(escape(k) for k in sorted(keywords, key=lambda k: (-len(k), k)))
    return f"(?i){LEFT}(?:{body}){RIGHT}" if java else f"(?i)\\b(?:{body})\\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACES}|{SPACES}$", "")


def normalize_ws(c: Column) -> Column:
    """Runs of white space to a space, a space after punctuation that a word character follows, trimmed."""
    c = F.regexp_replace(c, SPACES, " ")
    return F.trim(F.regexp_replace(c, rf"([.,;!?])({WORD})", "$1 $2"))


def expand_abbreviations(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Lower-cases, then replaces whole words in the order given; each sees what those before made."""
    return reduce(lambda acc, p: F.regexp_replace(acc, LEFT + escape(p[0]) + RIGHT, p[1].replace("\\", "\\\\").replace("$", "\\$")), pairs, F.lower(c))


def normalize_cve(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i){LEFT}cve[- \t\n]?(\d{{4}})[- \t\n]?(\d{{1,7}}){RIGHT}", "CVE-$1-$2")


def clean_markdown(c: Column) -> Column:
    """Fences, inline code, headers, links, images, in that order: links run before images."""
    for pattern, by in ((r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1")):
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_html(c: Column) -> Column:
    """Text of a page: scripts and styles gone, tags to spaces, white space to single spaces."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def snippet(text: Column, keyword: Column, margin: int = 50) -> Column:
    """The first occurrence with `margin` characters on each side; null where there is none."""
    at = F.locate(keyword, text) if isinstance(keyword, str) else F.instr(text, keyword)
    start = F.greatest(at - margin, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(keyword) + margin - start))


def first_sentences(c: Column, n: int = 1) -> Column:
    return F.substring_index(c, ".", n)


def parse_list(c: Column) -> Column:
    """Parts between double colons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, "::"), lambda p: F.trim(p)), lambda p: p != "")


def related_weaknesses(c: Column, fixed: bool = False) -> Column:
    """CWE ids of `::276::285::`; unless `fixed`, a match takes its right delimiter along and every second id is lost."""
    ids = F.filter(parse_list(c), lambda p: p.rlike(r"^\d+$")) if fixed else F.regexp_extract_all(c, F.lit(r"::(\d+)::"), 1)
    return F.transform(ids, lambda i: F.concat(F.lit("CWE-"), i))


def _parts(c: Column) -> Column:
    """What stands between double colons, or the whole text if it has none; blanks dropped."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(c.contains("::"), parse_list(c)).otherwise(F.array(F.trim(c)))


def parse_skills(c: Column) -> Column:
    """(skill, level) of `::SKILL:a:LEVEL:b::`; else each part, or the text, with level Unknown."""
    text, level = (F.regexp_extract_all(c, F.lit(r"::SKILL:([^:]+):LEVEL:([^:]+)::"), g) for g in (1, 2))
    told = F.transform(F.arrays_zip(text.alias("skill"), level.alias("level")), lambda z: F.struct(F.trim(z["skill"]).alias("skill"), F.trim(z["level"]).alias("level")))
    plain = F.transform(_parts(c), lambda p: F.struct(p.alias("skill"), F.lit("Unknown").alias("level")))
    return F.when(F.size(text) > 0, told).otherwise(plain)


def parse_consequences(c: Column) -> Column:
    """(text, scopes, impact, note) of `::SCOPE:a:SCOPE:b:TECHNICAL IMPACT:c:NOTE:d::`; else each part as text, impact Unknown."""
    found = F.regexp_extract_all(c, F.lit(r"::(?:SCOPE:[^:]+:)*TECHNICAL IMPACT:[^:]+(?::NOTE:[^:]+)?::"), 0)
    none = F.array().cast("array<string>")

    def one(m: Column) -> Column:
        scopes = F.transform(F.regexp_extract_all(m, F.lit(r"SCOPE:([^:]+):"), 1), lambda x: F.trim(x))
        impact, note = F.regexp_extract(m, r"TECHNICAL IMPACT:([^:]+)", 1), F.regexp_extract(m, r":NOTE:([^:]+)::$", 1)
        return F.struct(F.lit("").alias("text"), scopes.alias("scopes"), F.trim(impact).alias("impact"), F.trim(note).alias("note"))

    plain = F.transform(_parts(c), lambda p: F.struct(p.alias("text"), none.alias("scopes"), F.lit("Unknown").alias("impact"), F.lit("").alias("note")))
    return F.when(F.size(found) > 0, F.transform(found, one)).otherwise(plain)


def parse_taxonomy(c: Column) -> Column:
    """(taxonomy, entry_id, entry_name) of each entry between four colons that names a taxonomy."""
    entries = F.filter(F.split(c, "::::"), lambda e: e.rlike(r"TAXONOMY NAME:[^:]+"))
    field = lambda e, name: F.trim(F.regexp_extract(e, rf"{name}:([^:]+)", 1))
    return F.transform(entries, lambda e: F.struct(field(e, "TAXONOMY NAME").alias("taxonomy"), field(e, "ENTRY ID").alias("entry_id"), field(e, "ENTRY NAME").alias("entry_name")))


def keyword_list(c: Column) -> Column:
    """Keywords given as a JSON array, or else parted by commas."""
    listed = F.from_json(c, "array<string>")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).when(F.trim(c).startswith("["), listed).otherwise(F.transform(F.split(c, ","), lambda p: F.trim(p)))


def parse_execution_flow(c: Column) -> Column:
    parts = [F.regexp_extract_all(c, F.lit(r"STEP:(\d+):PHASE:([^:]+):DESCRIPTION:([^:]+):TECHNIQUE:([^:]+)"), g).alias(n) for g, n in ((1, "step"), (2, "phase"), (3, "description"), (4, "technique"))]
    return F.arrays_zip(*parts)


def parse_related_patterns(c: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in {"ChildOf": "CHILD_OF", "ParentOf": "PARENT_OF", "CanFollow": "CAN_FOLLOW", "CanPrecede": "CAN_PRECEDE"}.items() for x in kv])
    nature, ident = (F.regexp_extract_all(c, F.lit(r"NATURE:([^:]+):CAPEC ID:(\d+)"), g) for g in (1, 2))
    return F.transform(F.arrays_zip(nature.alias("n"), ident.alias("i")), lambda z: F.struct(F.coalesce(kinds[z["n"]], F.lit("RELATED_TO")).alias("type"), F.concat(F.lit("CAPEC-"), z["i"]).alias("capec_id")))


def taxonomy_attack_ids(c: Column) -> Column:
    """Technique ids among the entries of a taxonomy mapping whose taxonomy names ATTACK."""
    entries = F.filter(parse_taxonomy(c), lambda e: F.upper(e["taxonomy"]).contains("ATTACK") & (e["entry_id"] != ""))
    return F.transform(entries, lambda e: F.when(e["entry_id"].startswith("T"), e["entry_id"]).otherwise(F.concat(F.lit("T"), e["entry_id"])))


def key_values(c: Column) -> Column:
    """Entries parted by double pipes, each `k=v;k=v`; a single entry without a double pipe yields none."""
    entries = F.filter(F.split(c, r"\|\|"), lambda e: F.trim(e) != "")
    return F.when(c.contains("||"), F.transform(entries, lambda e: F.str_to_map(e, F.lit(";"), F.lit("=")))).otherwise(F.array().cast("array<map<string,string>>"))


def date_normalise(c: Column) -> Column:
    """ISO dates as they are, month/day/year turned, anything else ''."""
    d = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")).when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(c, "M/d/yyyy"))
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))


def uri_tail(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/#]*)$", 1)


def mentions(c: Column, kind: str) -> Column:
    """All ids of a kind (cve, cwe, capec, technique) in a text, upper-cased, with repeats."""
    pattern = {"cve": r"(?i)CVE-\d{4}-\d{1,7}", "cwe": r"(?i)CWE-\d+", "capec": r"CAPEC-\d+", "technique": r"T\d{4}(?:\.\d{3})?"}[kind]
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda m: F.upper(m))


def text_hash(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))


def cache_key(text: Column, threshold: float, top_k: int, ensemble: bool, extractors: list[str]) -> Column:
    """Hash of the text, and eight digits of the hash of the options in their canonical form."""
    options = f"{threshold}_{top_k}_{ensemble}_{','.join(sorted(extractors))}"
    return F.concat(text_hash(text), F.lit("_"), F.substring(F.md5(F.lit(options)), 1, 8))


def color(score: Column) -> Column:
    """Colours of the score bands."""
    return F.when(score >= 0.8, "#ff6666").when(score >= 0.5, "#ffb366").when(score >= 0.3, "#ffff99").otherwise("#ffffdd")


def query_type(c: Column) -> Column:
    q = F.upper(strip(c))
    kind = F.when(q.isNull() | (q == ""), "unknown")
    for word in ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"):
        kind = kind.when(q.startswith(word), word.lower())
    for word, name in (("CREATE", "match_create"), ("DELETE", "match_delete"), ("SET", "match_update")):
        kind = kind.when(q.startswith("MATCH") & q.contains(word), name)
    return kind.when(q.startswith("MATCH"), "match").when(q.startswith("MERGE"), "merge").otherwise("other")


def entity_type(c: Column) -> Column:
    """Type of a graph id by its prefix; the first rule that fits counts."""
    kind = F.when(c.rlike(r"^T\d+"), "technique")
    for prefix, name in (("CVE-", "cve"), ("CWE-", "cwe"), ("CAPEC-", "capec"), ("S", "software"), ("G", "group"), ("M", "mitigation")):
        kind = kind.when(c.startswith(prefix), name)
    return kind.otherwise("unknown")


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").when(ext.isin("md", "markdown"), "markdown").otherwise("text")


def truncate(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def keyword_preview(a: Column, n: int = 5) -> Column:
    return F.concat(F.array_join(F.slice(a, 1, n), ", "), F.when(F.size(a) > n, "...").otherwise(""))


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot / F.when(scale == 0, F.lit(1.0)).otherwise(scale))


def cosine_clamped(a: Column, b: Column) -> Column:
    """Cosine similarity held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def chunks(c: Column, size: int = 5000, overlap: int = 500, threshold: int = 25_000) -> Column:
    """Array of (chunk_id, start, end, text): fixed windows of long texts; a short text is one chunk."""
    n, step = F.length(c), size - overlap
    starts = F.when(n > threshold, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array(F.lit(0)))
    wide = F.when(n > threshold, F.lit(size)).otherwise(n)
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_id"), s.alias("start"), F.least(s + wide, n).alias("end"), F.substring(c, s + 1, wide).alias("text")))
