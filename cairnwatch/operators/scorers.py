"""Scorers: documents (doc_id, text) against the taxonomy, giving candidates (doc_id, technique_id, ...).

Keywords are matched in one pass a text (see matching). Top-k uses row_number() <= k, which
Spark prunes before it shuffles (WindowGroupLimit).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx
from cairnwatch.operators import matching
from cairnwatch.operators.matching import grouped
from cairnwatch.sources.shared import small_batches

#: Keywords that a signal of the technique adds.
SIGNAL_KEYWORDS = {"T1190": ["web exploit"], "T1133": ["vpn", "remote service"], "T1566": ["phishing"], "T1059": ["script", "command interpreter"], "T1027": ["obfuscated", "encoded"]}
#: Technique, patterns of which one must occur, keywords that it then adds.
CONTEXTUAL = [
    ("T1071", [r"(outbound|external)\s+connection", r"(command|control)\s+server", r"beacon\s+(to|back)"], ["command and control", "external communication"]),
    ("T1068", [r"(elevated|higher|admin)\s+privilege", r"(escalate|increase)\s+(privilege|permission)"], ["privilege escalation", "elevation"]),
    ("T1021", [r"(move|spread|pivot)\s+(across|between|to other)\s+(system|host|machine|network)", r"lateral\s+movement"], ["lateral movement", "remote services"]),
    ("T1053", [r"(maintain|establish|ensure)\s+(access|presence)", r"(persist|persistent|persistence)"], ["persistence", "scheduled task"]),
    ("T1562", [r"(avoid|evade|bypass)\s+(detection|monitoring|defense)", r"(disable|impair)\s+(security|antivirus|firewall)"], ["defense evasion", "impair defenses"]),
]


def top_k(df: DataFrame, k: int, score: str = "confidence", by: str = "doc_id", tie: str = "technique_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def rule_v1(docs: DataFrame, keywords: list[tuple[str, str]], signals: list[tuple[str, str]] = (), min_confidence: float = 0.1, keys: tuple[str, ...] = ("doc_id",), contexts: list = ()) -> DataFrame:
    """matching.rule_v1 with the fixed keywords of the signals."""
    return matching.rule_v1(docs, keywords, signals, min_confidence, keys, SIGNAL_KEYWORDS, contexts)


rule_v2, score_v2 = matching.rule_v2, matching.score_v2


def _terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), tx.SPACES), lambda w: w != "")


#: Terms of a vocabulary that go to every task at most; a larger one is joined.
MOST_TERMS = 1_000_000


def query_terms(docs: DataFrame, vocabulary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(doc_id, term, qtf) of the documents' words that occur in the vocabulary (term), a dimension.

    Words are counted where the text is read, so that neither they nor texts are shuffled.
    """
    listed = vocabulary.select("term").distinct().limit(most + 1).collect()
    if len(listed) > most:
        words = docs.select("doc_id", F.explode(_terms(F.col("text"))).alias("term"))
        return words.join(vocabulary, "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    known = frozenset(r.term for r in listed)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, counts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = Counter((text or "").lower().split())
                for term in words.keys() & known:
                    at.append(i)
                    terms.append(term)
                    counts.append(words[term])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "term", "qtf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, term string, qtf long")


def postings(corpus: DataFrame) -> DataFrame:
    """(row_id, term, tf, dl) of a corpus (row_id, body)."""
    words = corpus.select("row_id", F.explode(_terms(F.col("body"))).alias("term"))
    tf = words.groupBy("row_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("dl", F.sum("tf").over(W.partitionBy("row_id")))


def corpus_stats(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and one row (n_rows, avgdl)."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = post.groupBy("row_id").agg(F.first("dl").alias("dl"))
    return df, rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"))


def bm25_v1(docs: DataFrame, corpus: DataFrame, variant: str = "plus", k1: float = 1.5, b: float = 0.75, delta: float = 1.0, most: int = 10) -> DataFrame:
    """Raw scores (doc_id, row_id, raw) of BM25+ or Okapi with repeated query words counted.

    BM25+ adds idf * delta for every query word to every row of the corpus, whether the word
    is in it or not. Rows without a query word all have that same score, below all others:
    of these the `most` with the smallest ids are given, which is all that a ranking of
    `most` rows can show, and documents never meet the whole taxonomy.
    """
    post = postings(corpus)
    df, totals = corpus_stats(post)
    df = df.crossJoin(totals)  # one row
    if variant == "plus":
        df = df.withColumn("idf", F.log((F.col("n_rows") + 1) / F.col("df")))
    else:
        idf = F.log(F.col("n_rows") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        df = df.withColumn("i", idf)
        df = df.crossJoin(df.agg(F.avg("i").alias("mean")))  # one row
        df = df.withColumn("idf", F.when(F.col("i") < 0, 0.25 * F.col("mean")).otherwise(F.col("i")))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = df.select("term", "idf", "avgdl")
    worth = post.join(known, "term").select("term", "row_id", (F.col("idf") * weight).alias("worth"))
    if variant != "plus":
        scored = query_terms(docs, known.select("term")).join(worth, "term").groupBy("doc_id", "row_id").agg(F.sum(F.col("qtf") * F.col("worth")).alias("part"))
        return scored.select("doc_id", "row_id", F.col("part").alias("raw"))
    scored = _with_base(docs, worth, known.select("term", (F.col("idf") * delta).alias("worth")))
    ids = corpus.agg(F.array_sort(F.collect_list("row_id")).alias("ids"))  # one row, the taxonomy's ids
    by_doc = scored.crossJoin(ids)
    others = F.array_except(F.slice("ids", 1, F.size("hits") + most), F.transform("hits", lambda h: h["row_id"]))
    rest = F.transform(F.slice(others, 1, most), lambda i: F.struct(i.alias("row_id"), F.lit(0.0).alias("part")))
    every = by_doc.select("doc_id", "base", F.explode(F.concat("hits", rest)).alias("h"))
    return every.select("doc_id", "h.row_id", (F.col("base") + F.col("h.part")).alias("raw"))


def _with_base(docs: DataFrame, worth: DataFrame, each: DataFrame, repeated: bool = True) -> DataFrame:
    """(doc_id, base, hits): of each document with a known word the rows that hold one, with their sums of worth, and its base.

    worth: (term, row_id, worth) of the rows; each: (term, worth), what a term adds to the base.
    The base is summed as one more row, without an id, so that texts are read and counted
    once. repeated: whether a document's word counts as often as it stands there.
    """
    empty = F.lit(None).cast(worth.schema["row_id"].dataType).alias("row_id")
    every = worth.unionByName(each.select("term", empty, "worth"))
    times = F.col("qtf") if repeated else F.lit(1)
    parts = query_terms(docs, each.select("term")).join(every, "term").groupBy("doc_id", "row_id").agg(F.sum(times * F.col("worth")).alias("part"))
    base = F.max(F.when(F.col("row_id").isNull(), F.col("part"))).alias("base")
    hits = F.collect_list(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "part"))).alias("hits")
    return parts.groupBy("doc_id").agg(base, hits)


def bm25_v2(docs: DataFrame, fields: DataFrame, variant: str = "plus", k1: float = 1.5, b: float = 0.75, delta: float = 1.0, most: int = 10) -> DataFrame:
    """(doc_id, technique_id, field, raw): best weighted field of each technique.

    fields: (row_id, technique_id, field, weight, body), a row for each name, description and
    keyword. The plus variant adds delta for every query word known to the corpus to every
    row, outside idf; a technique without a query word has its heaviest field's share of
    that, and of such techniques the `most` first by weight and id are given. The Okapi
    variant leaves out rows of score zero. Query words count once.
    """
    post = postings(fields)
    df, totals = corpus_stats(post)
    n, d = F.col("n_rows"), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5)) if variant == "plus" else F.log((n - d + 0.5) / (d + 0.5) + 1e-10)
    df = df.crossJoin(totals).withColumn("idf", idf)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = df.select("term", "idf", "avgdl")
    worth = post.join(known, "term").select("term", "row_id", (F.col("idf") * weight).alias("worth"))
    rows = fields.select("row_id", "technique_id", "field", "weight")
    best = lambda of: F.min(F.struct((-F.col(of)).alias("m"), "row_id", "field"))
    if variant != "plus":
        scored = query_terms(docs, known.select("term")).join(worth, "term").groupBy("doc_id", "row_id").agg(F.sum("worth").alias("part"))
        raw = scored.join(rows, "row_id").withColumn("raw", F.round(F.col("part") * F.col("weight"), 6)).where("part * weight <> 0")
        return raw.groupBy("doc_id", "technique_id").agg(best("raw").alias("b")).select("doc_id", "technique_id", "b.field", (-F.col("b.m")).alias("raw"))
    scored = _with_base(docs, worth, known.select("term", F.lit(float(delta)).alias("worth")), repeated=False)
    hits = scored.select("doc_id", "base", F.explode("hits").alias("h")).select("doc_id", "base", "h.*")
    raw = hits.join(rows, "row_id").withColumn("raw", F.round((F.col("base") + F.col("part")) * F.col("weight"), 6))
    heaviest = rows.groupBy("technique_id").agg(best("weight").alias("w"))
    share = lambda w, base: F.struct((-F.round(-w["m"] * base, 6)).alias("m"), w["row_id"].alias("row_id"), w["field"].alias("field"))
    # Without a hit in its heaviest field, that field's share of the base may still be a technique's best.
    hit = raw.groupBy("doc_id", "technique_id").agg(best("raw").alias("b"), F.first("base").alias("base")).join(heaviest, "technique_id")
    hit = hit.select("doc_id", "technique_id", "base", F.least("b", share(F.col("w"), F.col("base"))).alias("b"))
    order = heaviest.agg(F.array_sort(F.collect_list(F.struct("w.m", "technique_id", "w.row_id", "w.field"))).alias("order"))  # one row, the taxonomy's techniques
    by_doc = hit.groupBy("doc_id").agg(F.first("base").alias("base"), F.collect_list(F.struct("technique_id", "b")).alias("hits")).crossJoin(order)
    mine = F.transform("hits", lambda h: h["technique_id"])
    # Only so many of the order's first as can be missing from the hits are looked at.
    rest = F.slice(F.filter(F.slice("order", 1, F.size("hits") + most), lambda w: ~F.array_contains(mine, w["technique_id"])), 1, most)
    rest = F.transform(rest, lambda w: F.struct(w["technique_id"].alias("technique_id"), share(w, F.col("base")).alias("b")))
    every = by_doc.select("doc_id", F.explode(F.concat("hits", rest)).alias("h"))
    return every.select("doc_id", "h.technique_id", "h.b.field", (-F.col("h.b.m")).alias("raw"))


def normalised(scores: DataFrame, raw: str = "raw", threshold: float = 0.1, by: str = "doc_id") -> DataFrame:
    """confidence = raw / greatest raw of the document, from the threshold on; the threshold can't go below the maximum."""
    rows = scores.withColumn("_top", F.max(raw).over(W.partitionBy(by))).where("_top > 0")
    return rows.withColumn("confidence", F.round(F.col(raw) / F.col("_top"), 6)).where(F.col("confidence") >= threshold).drop("_top")


#: Words that the tokenizer drops, and patterns it keeps whole.
STOPWORDS = ["the", "and", "or", "a", "an", "is", "it", "this", "that", "these", "those", "be", "to", "of", "in", "for", "with", "by", "at", "on", "from"]
PROTECTED = r"cve-[0-9]{4}-[0-9]{1,7}|cwe-[0-9]+|t[0-9]{4}(?:\.[0-9]{3})?|\b(?:xss|csrf|rce|sqli|ssrf|xxe|idor|mitm|dos|ddos|apt|c2|ttp)\b"
#: Single-word synonyms and their canonical term.
SYNONYMS = {"adversary": "attacker", "hacker": "attacker", "virus": "malware", "trojan": "malware", "steal": "exfiltrate", "extract": "exfiltrate", "leak": "exfiltrate", "transfer": "exfiltrate", "upload": "exfiltrate", "weakness": "vulnerability", "exploit": "vulnerability", "bug": "vulnerability", "pivoting": "lateral movement", "autostart": "persistence", "startup": "persistence", "privesc": "privilege escalation"}


_PROTECTED, _WORD, _STOP = re.compile(PROTECTED), re.compile(r"\w+"), frozenset(STOPWORDS)
#: What stands between other characters: ids, short names and letters that touch.
_STRETCH = re.compile(rf"(?:{PROTECTED}|\w)+")


def tokenize(text: str | None) -> list[str]:
    """Tokens of a text: ids and short names whole, other words without stopwords, single-word synonyms made canonical.

    An id that touches letters is no token: in the token of its stretch the number of the id
    within the text stands for it, and the id itself comes at the end, once, unless it stands
    alone elsewhere.
    """
    low = (text or "").lower()
    if not _PROTECTED.search(low):
        return [SYNONYMS.get(w, w) for w in _WORD.findall(low) if w not in _STOP]
    tokens, touching, seen = [], [], 0
    for stretch in _STRETCH.finditer(low):
        word = stretch[0]
        ids = list(_PROTECTED.finditer(low, *stretch.span()))
        if not ids:
            if word not in _STOP:
                tokens.append(SYNONYMS.get(word, word))
        elif ids[0].span() == stretch.span():
            tokens.append(word)
        else:
            cuts = [stretch.start(), *(at for m in ids for at in m.span()), stretch.end()]
            between = [low[b:e] for b, e in zip(cuts[::2], cuts[1::2])]
            numbered = [f"__PRESERVED_{seen + k}__" for k in range(len(ids))]
            tokens.append("".join(x for pair in zip(between, [*numbered, ""]) for x in pair))
            touching += [m[0] for m in ids]
        seen += len(ids)
    alone = set(tokens)
    return tokens + [v for v in dict.fromkeys(touching) if v not in alone]


def security_tokens(c: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(tokenize), "array<string>")(c)


def kev(docs: DataFrame, cve_technique: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mentioned CVEs with a mapping; per technique the highest confidence, its CVE and all CVEs."""
    cves = docs.select("doc_id", F.explode(F.array_distinct(tx.mentions(F.col("text"), "cve"))).alias("cve_id"))
    hits = cves.join(cve_technique, "cve_id").where(F.col("confidence") >= threshold)
    return hits.groupBy("doc_id", "technique_id").agg(F.max("confidence").alias("confidence"), F.min(F.struct(-F.col("confidence"), "cve_id"))["cve_id"].alias("cve_id"), F.array_sort(F.collect_set("cve_id")).alias("cve_ids"))


def cve_to_techniques(cves: DataFrame, cve_technique: DataFrame, cve_cwe: DataFrame, cwe_technique: DataFrame, parts: int | None = None) -> DataFrame:
    """Direct mappings, and those through a weakness for techniques that the CVE has no direct one for (0.6).

    parts: partitions that the direct mappings are dealt over, so that a task's share doesn't grow
    with them; without it Spark merges them by their compressed bytes. They may hold repeats.
    """
    known = cve_technique.repartition(parts, "cve_id") if parts else cve_technique
    direct = cves.join(known, "cve_id").select("cve_id", "technique_id", "confidence", F.lit("direct").alias("source"))
    via = cves.join(cve_cwe, "cve_id").join(cwe_technique, "cwe_id")
    pairs = cve_technique.select("cve_id", "technique_id")
    via = via.join(pairs.repartition(parts, "cve_id", "technique_id") if parts else pairs, ["cve_id", "technique_id"], "left_anti")
    return direct.distinct().unionByName(via.select("cve_id", "technique_id", F.lit(0.6).alias("confidence"), F.concat(F.lit("cwe_derived:"), "cwe_id").alias("source")))


def cwe_to_techniques(cve_cwe: DataFrame, cve_technique: DataFrame, parts: int | None = None) -> DataFrame:
    """How many CVEs tie a weakness to a technique. parts: see cve_to_techniques.

    Each CVE's pairs are made distinct where it lies, so that what goes on are counts.
    """
    pairs = cve_technique.select("cve_id", "technique_id")
    known = (pairs.repartition(parts, "cve_id") if parts else pairs).distinct()
    tied = cve_cwe.select("cve_id", "cwe_id").distinct().join(known, "cve_id")
    return tied.groupBy("cwe_id", "technique_id").agg(F.count(F.lit(1)).alias("cve_count")).withColumn("confidence", F.lit(0.7))


def cwe_map(techniques: DataFrame, fixed: DataFrame, rules: DataFrame) -> DataFrame:
    """The fixed weakness map with what the techniques' descriptions suggest, without repeats."""
    low = techniques.select("technique_id", F.lower("description").alias("d"))
    told = low.join(F.broadcast(rules), F.col("d").contains(F.col("word_a")) & F.col("d").contains(F.col("word_b")))  # a fixed table
    return fixed.select("cwe_id", "technique_id").unionByName(told.select("cwe_id", "technique_id")).distinct()


entity_mentions = matching.mentions


def entity_pairs(entities: list[tuple[str, str]], keywords: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(entity, keyword, technique_id) where one contains the other, of two dimension lists."""
    techniques: dict[str, set[str]] = {}
    for t, k in keywords:
        techniques.setdefault(k, set()).add(t)
    return sorted({(e, k, t) for e, k in matching.overlaps([e for e, _ in entities], list(techniques)) for t in techniques[k]})


def replace_keywords(keywords: DataFrame, new: DataFrame) -> DataFrame:
    """The keyword table with the lists of the techniques in `new` replaced."""
    return keywords.join(new.select("technique_id").distinct(), "technique_id", "left_anti").select("technique_id", "keyword").unionByName(new.select("technique_id", "keyword"))


def ner_match(mentions: DataFrame, pairs: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """Techniques by matching entities: 0.4 + 0.05 for each, 0.85 at most; with affinity the calibrated second form."""
    hits = mentions.join(pairs, "entity")
    found = hits.groupBy("doc_id", "technique_id").agg(F.countDistinct("entity").alias("n_entities"), F.countDistinct("entity", "keyword").alias("match_count"), F.collect_set("entity_type").alias("types"))
    if affinity is None:
        return found.select("doc_id", "technique_id", "n_entities", "match_count", F.round(F.least(F.lit(0.4) + F.lit(0.05) * F.col("n_entities"), F.lit(0.85)), 6).alias("confidence"))
    # Types come in no order: the largest boost that any of them gives counts.
    exact = affinity.select("entity_type", F.col("technique_id"), F.lit(1.2).alias("boost"))
    family = affinity.where(F.col("technique_id").contains(".")).select("entity_type", F.split_part("technique_id", F.lit("."), F.lit(1)).alias("parent")).distinct()
    types = found.select("doc_id", "technique_id", "n_entities", "match_count", F.explode("types").alias("entity_type"))
    boosted = types.join(exact, ["entity_type", "technique_id"], "left").join(family.withColumn("by_parent", F.lit(1.1)).withColumnRenamed("entity_type", "ft"), (F.col("entity_type") == F.col("ft")) & F.col("technique_id").startswith(F.col("parent")), "left")
    best = boosted.groupBy("doc_id", "technique_id", "n_entities", "match_count").agg(F.max(F.coalesce("boost", "by_parent", F.lit(1.0))).alias("boost"))
    base = F.least(F.lit(0.4) + F.lit(0.05) * F.col("n_entities"), F.lit(0.75))
    return best.select("doc_id", "technique_id", "n_entities", "match_count", "boost", F.round(F.least((F.lit(0.3) + F.lit(0.5) * base) * F.col("boost"), F.lit(0.9)), 6).alias("confidence"))


def vector_topk(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", query_block: int = 1024, base_block: int = 16_384, threshold: float | None = None, digits: int | None = 4) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best base vectors of each query, exactly; ties by vec_id.

    Both sides are dealt into blocks of about so many vectors and each pair of blocks is one
    bounded matrix product, which hands on only its own k best a query; nothing goes through
    the driver. metric: cosine (zero norms score 0) or l2 (1 / (1 + squared distance)).
    Vectors rank, and are held against the threshold, by the full score; it is given to `digits` digits (all if None).
    """
    deal = lambda df, n, name: df.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name))
    nq, nb = _blocks(queries, query_block), _blocks(base, base_block)
    left = deal(queries, nq, "qb").select("*", _every(nb, "bb"))
    right = deal(base, nb, "bb").select("*", _every(nq, "qb"))
    return _best(left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(_against(k, metric), "query_id long, vec_id long, score double"), k, threshold, digits)


def by_segments(segments: DataFrame, techniques: DataFrame, k: int = 10, threshold: float = 0.5, metric: str = "cosine") -> DataFrame:
    """(doc_id, technique_id, confidence, n_segments, rank): the k techniques nearest to any segment of a document, from the threshold on.

    segments: (vec_id, doc_id, embedding), a row a segment; techniques: (vec_id, embedding).
    A technique scores as its nearest segment does; n_segments says how many of the
    document's have it among their own k best. A document's k best are among those of its
    segments, so that each segment hands on k techniques only.
    """
    best = vector_topk(segments, techniques, k, metric, digits=None).join(segments.select(F.col("vec_id").alias("query_id"), "doc_id"), "query_id")
    merged = best.groupBy("doc_id", F.col("vec_id").alias("technique_id")).agg(F.max("score").alias("confidence"), F.count(F.lit(1)).alias("n_segments"))
    return top_k(merged.where(F.col("confidence") >= threshold), k).withColumn("confidence", F.round("confidence", 4))


def vector_group_best(vectors: DataFrame, queries: DataFrame, query_block: int = 1024, base_block: int = 16_384) -> DataFrame:
    """(grp, query_id, n, best): the best cosine similarity of each group's vectors (vec_id, grp, embedding) to each query, in blocks."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            score = _scores(np.array(left["embedding"].tolist(), np.float64), np.array(right["embedding"].tolist(), np.float64), "cosine")
            for group, at in right.reset_index(drop=True).groupby("grp").indices.items():
                out.append(pd.DataFrame({"grp": group, "query_id": left["vec_id"].to_numpy(), "n": len(at), "best": score[:, at].max(1)}))
        return pd.concat(out) if out else pd.DataFrame({"grp": [], "query_id": [], "n": [], "best": []})

    nq, nb = _blocks(queries, query_block), _blocks(vectors, base_block)
    left = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int").alias("qb"), _every(nb, "bb"))
    right = vectors.select("vec_id", "grp", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int").alias("bb"))
    right = right.select("*", _every(nq, "qb"))
    schema = f"grp {vectors.schema['grp'].dataType.simpleString()}, query_id long, n long, best double"
    found = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(best, schema)
    return found.groupBy("grp", "query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def _every(n: int, name: str) -> Column:
    """A row for each block of the other side."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def _best(found: DataFrame, k: int, threshold: float | None = None, digits: int | None = 4) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = found if threshold is None else found.where(F.col("score") >= threshold)
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found if digits is None else found.withColumn("score", F.round("score", digits))


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    dot, a, b = q @ v.T, (q**2).sum(1), (v**2).sum(1)
    if metric == "cosine":
        scale = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
        return np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0.0)
    return 1 / (1 + np.maximum(a[:, None] + b[None, :] - 2 * dot, 0))


def _against(k: int, metric: str):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(queries) or not len(base):
            return none
        base = base.sort_values("vec_id")
        v, vec = np.array(base["embedding"].tolist(), np.float64), base["vec_id"].to_numpy()
        q, ids = np.array(queries["embedding"].tolist(), np.float64), queries["vec_id"].to_numpy()
        found = []
        for at in range(0, len(q), 64):  # so that a score matrix stays small
            # Rounding in the last digits must not part exact ties, which go to the smaller id.
            score = np.round(_scores(q[at : at + 64], v, metric), 12)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + 64], order.shape[1]), "vec_id": vec[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()}))
        return pd.concat(found)

    return run


#: Vectors that the inverted lists' centres are learnt from at most.
FIT_VECTORS = 20_000


def centres(base: DataFrame, n: int, seed: int = 42, rounds: int = 10, sample: int = FIT_VECTORS) -> np.ndarray:
    """n centres by k-means on `sample` vectors at most, those with the smallest hashes of their id."""
    rows = base.select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).collect()
    v = np.array([r.embedding for r in rows], np.float64)
    found = v[:n].copy()
    for _ in range(rounds):
        near = np.argmax(-((found**2).sum(1)[None, :] - 2 * v @ found.T), axis=1)
        for c in np.unique(near):
            found[c] = v[near == c].mean(0)
    return found


def vector_lists(queries: DataFrame, base: DataFrame, k: int, lists: int, probes: int, metric: str = "l2", block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of the `probes` inverted lists nearest to a query.

    Every base vector is in the list of its nearest centre; a list of more than `block`
    vectors is searched in blocks. The centres are learnt from a bounded sample (see
    centres); `probes` = `lists` makes the search exact.
    """
    middle = centres(base, lists)

    def nearest(m: int):
        def run(batches):
            for pdf in batches:
                v = np.array(pdf["embedding"].tolist(), np.float64).reshape(len(pdf), -1)
                order = np.argsort((middle**2).sum(1)[None, :] - 2 * v @ middle.T, axis=1, kind="stable")[:, :m] if len(pdf) else np.zeros((0, m), int)
                yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), m), "embedding": [e for e in pdf["embedding"] for _ in range(m)], "list": order.ravel()})

        return run

    deal = lambda df, m: df.select("vec_id", "embedding").mapInPandas(nearest(m), "vec_id long, embedding array<float>, list long")
    held = deal(base, 1)
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))  # a row a list
    right = held.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("n")).alias("bb"), "vec_id", "embedding")
    left = deal(queries, min(probes, len(middle))).join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bb"), "vec_id", "embedding")
    return _best(left.groupBy("list", "bb").cogroup(right.groupBy("list", "bb")).applyInPandas(_against(k, metric), "query_id long, vec_id long, score double"), k)
