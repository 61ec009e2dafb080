"""Knowledge-graph joins over an edge table (src, type, dst) and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx
from cairnwatch.sources.shared import parts_for


#: Names whose pairs of words make a task.
TASK_NAMES = 20_000
#: Edges that make a task.
TASK_EDGES = 250_000


def undirected(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(eid, a, b) with both directions of each edge; eid names the edge."""
    rows = edges if types is None else edges.where(F.col("type").isin(types))
    rows = rows.select(F.concat_ws("|", "src", "type", "dst").alias("eid"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return rows.unionByName(rows.select("eid", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def related_1hop(edges: DataFrame, types: list[str], confidence: float = 0.6) -> DataFrame:
    return undirected(edges, types).where("a <> b").select("a", "b").distinct().withColumn("confidence", F.lit(confidence))


def related_2hop(edges: DataFrame, types: list[str]) -> DataFrame:
    """Pairs one or two steps apart; a path doesn't use one edge twice and doesn't end where it began."""
    hop = undirected(edges, types)
    second = hop.select(F.col("eid").alias("eid2"), F.col("a").alias("m"), F.col("b").alias("c"))
    two = hop.join(second, F.col("b") == F.col("m")).where("eid <> eid2").select("a", F.col("c").alias("b"))
    return hop.select("a", "b").unionByName(two).where("a <> b").distinct()


def enrich(techniques: DataFrame, tactics: DataFrame, edges: DataFrame) -> DataFrame:
    """Techniques with their tactics and mitigations, each side collected by itself first."""
    t = tactics.groupBy("technique_id").agg(F.array_join(F.array_sort(F.collect_set("tactic")), ",").alias("tactics"))
    m = edges.where("type = 'MITIGATED_BY'").groupBy(F.col("src").alias("technique_id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("mitigations"))
    return techniques.join(t, "technique_id", "left").join(m, "technique_id", "left").select("technique_id", "name", F.coalesce("tactics", F.lit("")).alias("tactics"), F.coalesce("mitigations", F.lit("")).alias("mitigations"))


def fill(results: DataFrame, techniques: DataFrame) -> DataFrame:
    """Results (technique_id, name, description) with absent or empty fields filled from the dimension."""
    d = techniques.select("technique_id", F.col("name").alias("_n"), F.col("description").alias("_d"))
    rows = results.join(d, "technique_id", "left")
    pick = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(d)).otherwise(F.col(c))
    return rows.withColumn("name", pick("name", "_n")).withColumn("description", pick("description", "_d")).drop("_n", "_d")


def relationships(edges: DataFrame, most: int = 15) -> DataFrame:
    """For each technique its neighbours with their kind, `most` at most, by kind and id."""
    rows = undirected(edges).where(F.col("a").rlike(r"^T\d")).select(F.col("a").alias("technique_id"), F.col("b").alias("other"), F.split_part("eid", F.lit("|"), F.lit(2)).alias("type")).distinct()
    rows = rows.withColumn("other_kind", tx.entity_type(F.col("other"))).where(F.col("other_kind").isin("technique", "capec", "cve", "software"))
    rank = F.row_number().over(W.partitionBy("technique_id").orderBy("other_kind", "other", "type"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def context(techniques: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Techniques with mitigations counted and up to `most` similar ones, by id."""
    near = related_1hop(edges, ["SIMILAR_TO", "RELATED_TO"]).where(F.col("b").rlike(r"^T\d"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("r") <= most)
    near = near.groupBy(F.col("a").alias("technique_id")).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("similar"))
    m = edges.where("type = 'MITIGATED_BY'").groupBy(F.col("src").alias("technique_id")).agg(F.countDistinct("dst").alias("n_mitigations"))
    return techniques.select("technique_id").join(near, "technique_id", "left").join(m, "technique_id", "left").select("technique_id", F.coalesce("similar", F.lit("")).alias("similar"), F.coalesce("n_mitigations", F.lit(0)).alias("n_mitigations"))


def capec_mentions(docs: DataFrame, edges: DataFrame) -> DataFrame:
    hits = docs.select("doc_id", F.explode(F.array_distinct(tx.mentions(F.col("text"), "capec"))).alias("src"))
    rows = hits.join(edges.where("type IN ('MAPPED_TO', 'SIMILAR_TO')"), "src")
    return rows.select("doc_id", F.col("src").alias("capec_id"), F.col("dst").alias("technique_id"), F.lit(0.8).alias("confidence")).distinct()


def name_similarity(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of (id, name) tables that share `least` words, 2 or more: an equi-join on pairs of words, never all pairs.

    Names that share n words share n * (n - 1) / 2 pairs of words, and none if they share one
    only: a frequent word alone brings nothing together.
    """

    def pairs(d: DataFrame, i: str) -> DataFrame:
        words = F.filter(F.split(F.lower("name"), r"[^a-z0-9]+"), lambda w: w != "")
        names = d.groupBy(F.col("id").alias(i)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("ws"))
        two = F.flatten(F.transform("ws", lambda w, k: F.transform(F.slice("ws", k + 2, F.size("ws")), lambda v: F.concat_ws(" ", w, v))))
        return names.select(i, F.explode(two).alias("two")).repartition(n, "two")

    if least < 2:
        raise ValueError("names are compared by two words at least")
    n = parts_for(left.sparkSession, left.count() + right.count(), TASK_NAMES)
    shared = pairs(left, "a").join(pairs(right, "b"), "two").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    common = F.round((1 + F.sqrt(8 * F.col("n") + 1)) / 2).cast("long")
    return shared.select("a", "b", common.alias("n_common")).where(F.col("n_common") >= least)


def build_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, once each; nodes first and edges after, so no order of loading loses any."""
    n = parts_for(candidates.sparkSession, candidates.count(), TASK_EDGES)
    ids = lambda end: nodes.select(F.col("id").alias(end)).repartition(n, end)
    kept = candidates.repartition(n, "src").join(ids("src"), "src", "left_semi").repartition(n, "dst").join(ids("dst"), "dst", "left_semi")
    return kept.select("src", "type", "dst").distinct()


def paths(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, most: int = 3) -> DataFrame:
    """(start, end, hops, path): paths of 1 to `most` edges of the types from each start (id), no edge twice."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = e.select(F.col("src").alias("at"), F.concat_ws("|", "src", "type", "dst").alias("eid"), F.col("dst").alias("to")).distinct()
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("path"))
    found = None
    for hops in range(1, most + 1):
        now = now.join(e, "at").where(~F.array_contains("path", F.col("eid"))).select("start", F.col("to").alias("at"), F.concat("path", F.array("eid")).alias("path"))
        part = now.select("start", F.col("at").alias("end"), F.lit(hops).alias("hops"), "path")
        found = part if found is None else found.unionByName(part)
    return found


def job_graph(jobs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) of jobs (job_id, status) and results (result_id, job_id, technique_id), and PRODUCED edges (src, type, dst)."""
    nodes = jobs.select(F.concat(F.lit("job:"), "job_id").alias("id"), F.lit("job").alias("kind"), F.col("status").alias("label"))
    nodes = nodes.unionByName(results.select(F.concat(F.lit("result:"), "result_id").alias("id"), F.lit("result").alias("kind"), F.col("technique_id").alias("label")))
    edges = results.join(jobs.select("job_id"), "job_id", "left_semi").select(F.concat(F.lit("job:"), "job_id").alias("src"), F.lit("PRODUCED").alias("type"), F.concat(F.lit("result:"), "result_id").alias("dst"))
    return nodes, edges
