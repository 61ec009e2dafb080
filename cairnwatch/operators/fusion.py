"""Fusion of candidates (doc_id, extractor, technique_id, confidence, ...) into one ranking a document.

All forms are one aggregation by (doc_id, technique_id): Spark combines before it shuffles
and the dimension of weights is joined as a literal map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def combine_weighted(candidates: DataFrame, weights: dict[str, float], threshold: float = 0.2) -> DataFrame:
    """Weighted confidences; a lone one is boosted for CVEs and many keywords, several are averaged with a bonus.

    candidates: doc_id, technique_id, extractor, confidence, has_cve, n_keywords, one row an
    extractor. Candidates below the threshold after weighting are dropped first.
    """
    wc = F.col("confidence") * _lookup(weights, F.col("extractor"), 0.6)
    boost = F.when(F.col("has_cve"), 1.15).otherwise(1.0) * F.when(F.col("n_keywords") > 3, 1.1).otherwise(1.0)
    rows = candidates.withColumn("wc", wc).where(F.col("wc") >= threshold).withColumn("lone", F.least(F.col("wc") * boost, F.lit(1.0)))
    by = rows.groupBy("doc_id", "technique_id").agg(F.avg("wc").alias("mean"), F.countDistinct("extractor").alias("n"), F.max("lone").alias("lone"), F.array_join(F.sort_array(F.collect_set("extractor")), "+").alias("method"))
    score = F.when(F.col("n") >= 2, F.least(F.col("mean") * (F.lit(1.0) + F.lit(0.1) * F.least("n", F.lit(3))), F.lit(1.0))).otherwise(F.col("lone"))
    return by.select("doc_id", "technique_id", "method", F.round(score, 6).alias("confidence"))


#: Fixed values of the fixed ensemble.
FIXED_WEIGHT = {"rule_based": 0.25, "bm25": 0.2, "ner": 0.2, "kev": 0.25, "semantic": 0.1}


def fixed_ensemble(candidates: DataFrame) -> DataFrame:
    """Weighted sum, absent extractors counting nothing; bonuses for several extractors and for a known CVE."""
    w = _lookup(FIXED_WEIGHT, F.col("extractor"), 0.0)
    rows = candidates.groupBy("doc_id", "technique_id", "extractor").agg(F.max("confidence").alias("c")).withColumn("w", w)
    by = rows.groupBy("doc_id", "technique_id").agg(F.sum(F.col("c") * F.col("w")).alias("s"), F.sum((F.col("w") > 0).cast("int")).alias("n"), F.max((F.col("extractor") == "kev") & (F.col("c") > 0)).alias("k"))
    score = F.col("s") * F.when(F.col("n") > 1, F.lit(1.0) + F.lit(0.1) * F.col("n")).otherwise(1.0) * F.when(F.col("k"), 1.1).otherwise(1.0)
    return by.select("doc_id", "technique_id", F.col("n").cast("long").alias("n_extractors"), F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))


def advanced_ensemble(candidates: DataFrame, params: DataFrame, related: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """Calibrated weighted mean over the extractors present, bonuses for agreement and for related findings.

    params: extractor, weight, scale, shift; related: pairs (a, b) of related techniques.
    """
    rows = candidates.groupBy("doc_id", "technique_id", "extractor").agg(F.max("confidence").alias("c")).join(params, "extractor")
    calibrated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") * F.col("scale") + F.col("shift")))
    by = rows.groupBy("doc_id", "technique_id").agg((F.sum(calibrated * F.col("weight")) / F.sum("weight")).alias("m"), F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("n") > 1, F.least(F.col("m") * (F.lit(1.0) + F.lit(0.1) * F.least(F.col("n") - 1, F.lit(3))), F.lit(0.98))).otherwise(F.col("m"))
    by = by.withColumn("s", score)
    if related is None:
        by = by.withColumn("overlap", F.lit(0))
    else:
        other = by.select("doc_id", F.col("technique_id").alias("b"))
        near = by.join(related.withColumnRenamed("a", "technique_id"), "technique_id").join(other, ["doc_id", "b"]).groupBy("doc_id", "technique_id").agg(F.countDistinct("b").alias("overlap"))
        by = by.join(near, ["doc_id", "technique_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    boosted = F.least(F.col("s") * (F.lit(1.0) + F.lit(0.05) * F.least("overlap", F.lit(3))), F.lit(0.98))
    final = F.round(F.when((F.col("n") >= 2) & (F.col("overlap") > 0), boosted).otherwise(F.col("s")), 9)
    return by.select("doc_id", "technique_id", "n", F.col("overlap").cast("long").alias("overlap"), final.alias("confidence")).where(F.col("confidence") >= threshold)


def dedupe_max(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Best row of each technique, then the k best of a document."""
    first = F.row_number().over(W.partitionBy("doc_id", "technique_id").orderBy(F.col("confidence").desc(), "extractor"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "technique_id"))
    rows = candidates.withColumn("_f", first).where("_f = 1").withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("doc_id", "technique_id", "extractor", "confidence", "rank")


#: Patterns of technical content and of security terms, case ignored.
TECHNICAL = [r"CVE-[0-9]{4}-[0-9]{1,7}", r"RFC ?[0-9]{3,4}", r"IPv[46]|TCP|UDP|HTTPS?|FTP|SSH|TLS|SSL", r"0x[0-9a-f]+", r"[a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"]
SECURITY = [
    "malware|ransomware|virus|trojan|worm|botnet|backdoor|rootkit|keylogger|spyware", "exploit|vulnerability|patch|zero-day|attack|threat|compromise|breach|incident",
    "authentication|authorization|encryption|decryption|hash|cipher|key|credential", "firewall|IDS|IPS|SIEM|EDR|XDR|NDR|SOAR|SOC|MSSP",
]


def text_complexity(docs: DataFrame, text: str = "text") -> DataFrame:
    from cairnwatch.functions.text import LEFT, RIGHT, SPACES, WORD

    def density(patterns: list[str]) -> Column:
        total = F.lit(0)
        for p in patterns:
            total = total + F.regexp_count(F.col(text), F.lit(f"(?i){LEFT}(?:{p}){RIGHT}"))
        return total / F.greatest(F.col("word_count"), F.lit(1))

    rows = docs.select("doc_id", text, F.length(text).cast("long").alias("char_count"), F.regexp_count(text, F.lit(f"{WORD}+")).cast("long").alias("word_count"), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, SPACES, "") != "")).cast("long").alias("sentence_count"))
    rows = rows.withColumn("avg_sentence_length", F.when(F.col("sentence_count") > 0, F.col("word_count") / F.col("sentence_count")).otherwise(0.0))
    rows = rows.withColumn("t", density(TECHNICAL)).withColumn("s", density(SECURITY))
    score = F.least(F.lit(1.0), F.lit(0.3) * F.least(F.lit(1.0), F.col("t") * 10) + F.lit(0.7) * F.least(F.lit(1.0), F.col("s") * 5))
    return rows.select("doc_id", "char_count", "word_count", "sentence_count", F.round("avg_sentence_length", 6).alias("avg_sentence_length"), F.round("t", 6).alias("technical_density"), F.round("s", 6).alias("security_term_density"), F.round(score, 6).alias("technical_score"))


def adapt_weights(complexity: DataFrame, base: dict[str, float]) -> DataFrame:
    """(doc_id, extractor, weight): base weights turned by the text's measures, summing to one."""
    score, words, length = F.col("technical_score"), F.col("word_count"), F.col("avg_sentence_length")
    high, low, long_, short, complex_ = score > 0.7, score < 0.3, words > 1000, words < 100, length > 25
    turns = {
        "enhanced_rule_based": [(high, 0.9), (low, 1.2), (long_, 0.9), (short, 1.2), (complex_, 0.9)],
        "enhanced_bm25": [(high, 1.2), (low, 0.9), (short, 1.1)],
        "optimized_ner": [(high, 1.2), (complex_, 1.1)],
        "optimized_semantic": [(low, 1.2), (long_, 1.2), (short, 0.8), (complex_, 1.1)],
    }
    columns = {}
    for name, weight in base.items():
        c = F.lit(float(weight))
        for cond, by in turns.get(name, []):
            c = c * F.when(cond, by).otherwise(1.0)
        columns[name] = c
    total = sum(columns.values(), F.lit(0.0))
    rows = complexity.withColumn("_total", total).select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("extractor"), F.round(c / F.col("_total"), 6).alias("weight")) for n, c in columns.items()])).alias("w"))
    return rows.select("doc_id", "w.*")


#: What feedback does to an extractor's weight, and the weight's bounds.
UP, DOWN, HIGHEST, LOWEST = 1.05, 0.95, 1.5, 0.5


def feedback_weights(feedback: DataFrame, start: float = 1.0) -> DataFrame:
    """(extractor, n, weight) after folding feedback (extractor, seq, kind, suggested) in order of seq.

    Up by 5 % to 1.5 at most for kind `correct`; down by 5 % to 0.5 at least for `incorrect`
    with a suggested technique; anything else doesn't count. Each step is w -> clamp(f * w),
    and such steps compose to one of the same form, so that sorted ranges are folded where
    they lie and a hot extractor is never one task; a row a range and extractor is left to
    fold. Feedback that ties in seq is taken in any order.
    """

    def fold(batches):
        parts: dict[str, list[float]] = {}
        for pdf in batches:
            for name, up in zip(pdf["extractor"].tolist(), pdf["up"].tolist()):
                f = parts.setdefault(name, [1.0, -np.inf, np.inf, 0])
                by, low, high = (UP, -np.inf, HIGHEST) if up else (DOWN, LOWEST, np.inf)
                f[:] = f[0] * by, min(max(f[1] * by, low), high), min(max(f[2] * by, low), high), f[3] + 1
        yield pd.DataFrame([(n, *f) for n, f in parts.items()], columns=["extractor", "f", "low", "high", "n"]).astype({"extractor": "object", "f": "float64", "low": "float64", "high": "float64", "n": "int64"})

    counts = (F.col("kind") == "correct") | ((F.col("kind") == "incorrect") & (F.coalesce("suggested", F.lit("")) != ""))
    rows = feedback.where(counts).select("extractor", "seq", (F.col("kind") == "correct").alias("up"))
    width = int(feedback.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(width, "extractor", "seq").sortWithinPartitions("extractor", "seq").select("extractor", "up")
    parts = ordered.mapInPandas(fold, "extractor string, f double, low double, high double, n long").withColumn("part", F.spark_partition_id())
    by = parts.groupBy("extractor").agg(F.array_sort(F.collect_list(F.struct("part", "f", "low", "high"))).alias("p"), F.sum("n").alias("n"))
    weight = F.aggregate("p", F.lit(float(start)), lambda w, p: F.least(F.greatest(w * p["f"], p["low"]), p["high"]))
    return by.select("extractor", "n", F.round(weight, 6).alias("weight"))


def oversampled(candidates: DataFrame, weights: dict[str, float], k: int, threshold: float = 0.2) -> DataFrame:
    """The k best after combining, where each extractor was asked for 2 k: (doc_id, technique_id, method, confidence, rank)."""
    own = F.row_number().over(W.partitionBy("doc_id", "extractor").orderBy(F.col("confidence").desc(), "technique_id", "n_keywords"))
    fused = combine_weighted(candidates.withColumn("_r", own).where(F.col("_r") <= 2 * k), weights, threshold)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "technique_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def shift_positions(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (doc_id, chunk_id, position, ...) with the position in the whole text, by their chunk's start."""
    starts = chunks.select("doc_id", "chunk_id", F.col("start").alias("_start"))
    return hits.join(starts, ["doc_id", "chunk_id"]).withColumn("position", F.col("position") + F.col("_start")).drop("_start")


def chunk_merge(chunked: DataFrame) -> DataFrame:
    """Per document and technique over its chunks: highest confidence, all keywords, number of chunks."""
    rows = chunked.select("doc_id", "technique_id", "chunk_id", "confidence", F.explode_outer("keywords").alias("keyword"))
    return rows.groupBy("doc_id", "technique_id").agg(F.max("confidence").alias("confidence"), F.countDistinct("chunk_id").alias("n_chunks"), F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))


def merge_chunks(results: DataFrame) -> DataFrame:
    """(doc_id, technique_id, confidence, n_chunks, keywords, entities, component_scores) over the chunks of each document.

    results: (doc_id, chunk_id, technique_id, confidence, keywords array<string>, entities
    array<struct<text, type>>, component_scores map<string, double>), any of the last three
    null. The highest confidence counts, and of each component the highest score; keywords
    and entities are told apart by their text, an entity's type is that of its first chunk.
    Rows without a technique are left out. What a document's chunks repeat is merged before it
    is collected, so that a row holds distinct names only.
    """
    rows = results.where("technique_id IS NOT NULL")
    keys = ("doc_id", "technique_id")
    part = lambda kind, item, name, of, score: rows.select(*keys, F.lit(kind).alias("kind"), "chunk_id", F.explode(item).alias(*name)).select(*keys, "kind", "chunk_id", *of, score)
    no_type, no_score = F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("score")
    named = part("k", "keywords", ("name",), ("name", no_type), no_score)
    named = named.unionByName(part("e", "entities", ("x",), (F.col("x.text").alias("name"), F.col("x.type").alias("type")), no_score))
    named = named.unionByName(part("s", "component_scores", ("name", "score"), ("name", no_type), F.col("score").cast("double").alias("score")))
    merged = named.groupBy(*keys, "kind", "name").agg(F.min_by("type", F.struct("chunk_id", "type")).alias("type"), F.max("score").alias("score"))
    of = lambda kind, c: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, c)))
    sides = merged.groupBy(*keys).agg(of("k", F.col("name")).alias("keywords"), of("e", F.struct(F.col("name").alias("text"), "type")).alias("entities"), F.map_from_entries(of("s", F.struct("name", "score"))).alias("component_scores"))
    whole = rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.countDistinct("chunk_id").alias("n_chunks"))
    empty = {"keywords": F.array().cast("array<string>"), "entities": F.array().cast("array<struct<text: string, type: string>>"), "component_scores": F.create_map().cast("map<string, double>")}
    return whole.join(sides, list(keys), "left").select(*keys, "confidence", "n_chunks", *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def chunk_statistics(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Per document: its chunks, their sizes and times, and the techniques found in each and in all.

    chunks: (doc_id, chunk_id, size, ms), ms being how long a chunk took, null where that was
    not measured; results: (doc_id, chunk_id, technique_id). Chunks without a technique count.
    """
    found = results.where("technique_id IS NOT NULL")
    each = found.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    own = found.groupBy("doc_id").agg(F.countDistinct("technique_id").alias("total_techniques"))
    rows = chunks.join(each, ["doc_id", "chunk_id"], "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("size"), 4).alias("avg_chunk_size"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.sum("ms").alias("total_ms"), F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("avg_techniques"), F.max(F.coalesce("n", F.lit(0))).alias("most_techniques"),
    )
    return rows.join(own, "doc_id", "left").withColumn("total_techniques", F.coalesce("total_techniques", F.lit(0)))
