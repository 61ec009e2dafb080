"""Data-quality rules: each gives rows of issues, so that they add up by union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx

METHODS = ("rule_based", "bm25", "ner", "semantic", "classifier", "kev", "ensemble")


def _issues(df: DataFrame, keys: list[str], rules: list) -> DataFrame:
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda i: i.isNotNull())
    return df.select(*keys, F.explode(found).alias("issue"))


def check_results(results: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of results (technique_id, confidence, method, cve_id): required fields, formats, ranges, known ids."""
    rows = results.join(known.select("technique_id", F.lit(True).alias("_known")), "technique_id", "left")
    method = F.coalesce("method", F.lit(""))
    named = method.contains(METHODS[0])
    for m in METHODS[1:]:
        named = named | method.contains(m)
    bad_id = ~F.col("technique_id").rlike(r"^T\d+(\.\d+)?")
    return _issues(rows, keys, [
        (F.col("technique_id").isNull(), "missing technique_id"), (F.col("confidence").isNull(), "missing confidence"), (F.col("method").isNull(), "missing method"),
        (bad_id, "bad technique_id"), (F.col("technique_id").isNotNull() & ~bad_id & F.col("_known").isNull(), "unknown technique_id"),
        ((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"), (F.col("method").isNotNull() & ~named, "unknown method"),
        (F.col("cve_id").isNotNull() & ~F.col("cve_id").rlike(r"^CVE-\d{4}-\d{1,7}"), "bad cve_id"),
    ])


def check_schema(df: DataFrame, keys: list[str], required: list[str], types: dict[str, str] | None = None, patterns: dict[str, str] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Issues of rows: required fields, values that aren't of a type (by cast), that don't match a pattern or leave a range."""
    rules = [(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"missing {c}") for c in required]
    rules += [(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), f"{c} is no {t}") for c, t in (types or {}).items()]
    rules += [(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(p), f"bad {c}") for c, p in (patterns or {}).items()]
    rules += [(~F.col(c).try_cast("double").between(low, high), f"{c} out of range") for c, (low, high) in (ranges or {}).items()]
    return _issues(df, keys, rules)


#: Which kinds of ends a relationship allows.
ALLOWED = [("USES", "software", "technique"), ("USES", "group", "technique"), ("MAPPED_TO", "capec", "technique"), ("MITIGATED_BY", "technique", "mitigation"), ("RELATED_TO", "technique", "technique"), ("SIMILAR_TO", "technique", "technique")]


def check_relationships(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose kinds of ends their type doesn't allow."""
    rows = edges.withColumn("src_kind", tx.entity_type(F.col("src"))).withColumn("dst_kind", tx.entity_type(F.col("dst")))
    return rows.join(allowed, ["type", "src_kind", "dst_kind"], "left_anti").select("src", "type", "dst", "src_kind", "dst_kind")


def duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(ids: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sub-techniques (x.y) whose parent x is absent, within the same keys."""
    subs = ids.where(F.col("technique_id").contains(".")).select(*keys, "technique_id", F.split_part("technique_id", F.lit("."), F.lit(1)).alias("parent")).distinct()
    have = ids.select(*keys, F.col("technique_id").alias("parent")).distinct()
    return subs.join(have, [*keys, "parent"], "left_anti").select(*keys, "technique_id", "parent")


def temporal_coherence(ops: DataFrame) -> DataFrame:
    """Updates (entity_id, operation, ts, version, seq) that follow a delete, skip a version or lack a field."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    bad = empty("entity_id") | empty("operation") | F.col("ts").isNull()
    w = W.partitionBy("entity_id").orderBy("ts", "seq")
    rows = ops.where(~bad).withColumn("prev", F.lag("operation").over(w)).withColumn("before", F.lag("version").over(w))
    found = _issues(rows, ["entity_id", "seq"], [((F.col("prev") == "delete") & (F.col("operation") != "create"), "after delete"), (F.col("version") - F.col("before") > 1, "version gap")])
    return found.unionByName(ops.where(bad).select("entity_id", "seq", F.lit("missing fields").alias("issue")))


def metrics(results: DataFrame, issues: DataFrame) -> DataFrame:
    """One row an issue with its number and share of all results."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select("issue", "n", "total", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def trend(checks: DataFrame, n: int = 10) -> DataFrame:
    """How many of the last n checks (key, seq, issues) had any issue against the n before, for each key."""
    r = F.row_number().over(W.partitionBy("key").orderBy(F.col("seq").desc()))
    rows = checks.withColumn("r", r).where(F.col("r") <= 2 * n)
    bad = lambda within: F.sum((within & (F.col("issues") > 0)).cast("long"))
    by = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), bad(F.col("r") <= n).alias("recent"), bad(F.col("r") > n).alias("previous"))
    verdict = F.when(F.col("n") <= n, "insufficient_data").when(F.col("recent") < F.col("previous"), "improving").when(F.col("recent") > F.col("previous"), "worsening").otherwise("stable")
    return by.select("key", "recent", "previous", verdict.alias("trend"))
