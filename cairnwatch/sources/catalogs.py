"""Readers of the knowledge sources: taxonomy JSON, vulnerability, weakness and pattern catalogues, keyword files.

All read through Spark, so that any store that Spark reaches will do; columns are found by
the names that the catalogues have used over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwatch.functions import text as tx
from cairnwatch.functions.dates import flexible_date

_REF = T.ArrayType(T.StructType([T.StructField("source_name", T.StringType()), T.StructField("external_id", T.StringType()), T.StructField("url", T.StringType())]))
_PHASE = T.ArrayType(T.StructType([T.StructField("kill_chain_name", T.StringType()), T.StructField("phase_name", T.StringType())]))
STIX = T.StructType([T.StructField("objects", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("x_mitre_shortname", T.StringType()), T.StructField("x_mitre_platforms", T.ArrayType(T.StringType())), T.StructField("x_mitre_data_sources", T.ArrayType(T.StringType())),
    T.StructField("external_references", _REF), T.StructField("kill_chain_phases", _PHASE), T.StructField("relationship_type", T.StringType()), T.StructField("source_ref", T.StringType()), T.StructField("target_ref", T.StringType()),
    T.StructField("revoked", T.BooleanType()),
])))])


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row an object of a STIX bundle, with the id it has in the taxonomy."""
    return with_external(spark.read.schema(STIX).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*"))


def with_external(rows: DataFrame) -> DataFrame:
    own = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return rows.withColumn("external_id", F.get(own, 0)["external_id"]).withColumn("url", F.get(own, 0)["url"])


def stix_techniques(objects: DataFrame) -> DataFrame:
    """Techniques with their tactics, looked up by the phase's short name; phases without a tactic drop out."""
    tactics = objects.where("type = 'x-mitre-tactic'").select(F.col("x_mitre_shortname").alias("shortname"), F.col("name").alias("tactic"), F.col("external_id").alias("tactic_ref"))
    t = objects.where("type = 'attack-pattern' AND external_id IS NOT NULL")
    phases = t.select("external_id", F.explode("kill_chain_phases").alias("p")).select("external_id", F.col("p.phase_name").alias("shortname")).join(tactics, "shortname")
    by = phases.groupBy("external_id").agg(F.array_sort(F.collect_set("tactic")).alias("tactics"), F.array_sort(F.collect_set("tactic_ref")).alias("tactic_refs"), F.array_sort(F.collect_set("shortname")).alias("tactic_shortnames"))
    return t.join(by, "external_id", "left").select(F.col("external_id").alias("technique_id"), "name", "description", "tactics", "tactic_refs", "tactic_shortnames", F.col("x_mitre_platforms").alias("platforms"), F.col("x_mitre_data_sources").alias("data_sources"), "url")


def stix_edges(objects: DataFrame) -> DataFrame:
    """Relationships between objects that both have a taxonomy id, types upper-cased."""
    ids = objects.where("external_id IS NOT NULL").select("id", "external_id")
    r = objects.where("type = 'relationship'").select(F.upper(F.regexp_replace("relationship_type", "-", "_")).alias("type"), "source_ref", "target_ref")
    r = r.join(ids.select(F.col("id").alias("source_ref"), F.col("external_id").alias("src")), "source_ref")
    return r.join(ids.select(F.col("id").alias("target_ref"), F.col("external_id").alias("dst")), "target_ref").select("src", "type", "dst").distinct()


def _csv(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A CSV file; with `lines`, quoted fields may span lines, and a file is one task."""
    return spark.read.csv(path, header=True, multiLine=lines, quote='"', escape='"')


def _first_of(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key, as the file has them."""
    columns = [c for c in df.columns if c != "_place"]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), "_place").alias("r")).select("r.*")


def first(df: DataFrame, *names: str) -> Column:
    """The first of these columns that is there and given; '' without any."""
    have = {c.strip().strip("'").lower(): c for c in df.columns}
    found = [df[f"`{have[n.lower()]}`"] for n in names if n.lower() in have]
    return F.coalesce(*found, F.lit(""))


def kev_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Known exploited vulnerabilities, with their weaknesses as an array and dates as ISO text."""
    return kev_rows(_csv(spark, path))


def kev_rows(df: DataFrame) -> DataFrame:
    cve = F.upper(F.trim(first(df, "cveID", "cve_id", "cve")))
    listed = tx.mentions(first(df, "cwes", "cwe", "cwe_id"), "cwe")
    bare = F.transform(F.filter(F.split(first(df, "cwes", "cwe", "cwe_id"), ","), lambda p: F.trim(p).rlike(r"^\d+$")), lambda p: F.concat(F.lit("CWE-"), F.trim(p)))
    return df.select(
        F.when(cve.startswith("CVE-"), cve).otherwise(F.concat(F.lit("CVE-"), cve)).alias("cve_id"), first(df, "vendorProject", "vendor").alias("vendor"), first(df, "product").alias("product"),
        first(df, "vulnerabilityName", "name").alias("name"), flexible_date(first(df, "dateAdded", "date_added")).alias("date_added"), flexible_date(first(df, "dueDate", "due_date")).alias("due_date"),
        (first(df, "knownRansomwareCampaignUse") == "Known").alias("known_ransomware"), F.when(F.size(listed) > 0, listed).otherwise(bare).alias("cwes"),
    ).where("cve_id <> 'CVE-'")


def cve_technique_map(spark: SparkSession, path: str, confidence: float = 0.9) -> DataFrame:
    """(cve_id, technique_id, confidence), each pair once."""
    return mapping_rows(_csv(spark, path), confidence)


def mapping_rows(df: DataFrame, confidence: float = 0.9) -> DataFrame:
    cve = F.regexp_extract(first(df, "capability_id", "cve_id", "cve"), r"(CVE-\d+-\d+)", 1)
    return df.select(cve.alias("cve_id"), F.trim(first(df, "attack_object_id", "technique_id")).alias("technique_id")).where("cve_id <> '' AND technique_id <> ''").distinct().withColumn("confidence", F.lit(confidence))


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(technique_id, keyword, pos) of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("technique_id", "ks"))
    return whole.select("technique_id", F.posexplode("ks").alias("pos", "keyword"))


def cve_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Vulnerabilities with scores, weaknesses and configurations; a feed of one line a row is read by many tasks."""
    return feed_rows(_csv(spark, path, lines))


def feed_rows(df: DataFrame) -> DataFrame:
    score = lambda *n: F.coalesce(first(df, *n).try_cast("double"), F.lit(0.0))
    return df.select(first(df, "id", "cve_id").alias("cve_id"), first(df, "published").alias("published"), first(df, "description_en", "description").alias("description"), score("cvss31_basescore", "cvss31").alias("cvss31"), score("cvss2_basescore", "cvss2").alias("cvss2"), tx.mentions(first(df, "weaknesses"), "cwe").alias("cwes"), tx.key_values(first(df, "configurations")).alias("configurations")).where("cve_id LIKE 'CVE-%'")


def pattern_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Attack patterns, the first row of each id, their packed columns parsed."""
    return pattern_rows(_csv(spark, path))


def pattern_rows(df: DataFrame) -> DataFrame:
    df = df.withColumn("_place", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    ident = F.regexp_extract(first(df, "ID", "capec_id"), r"(\d+)", 1)
    rows = df.select(
        "_place",
        F.concat(F.lit("CAPEC-"), ident).alias("capec_id"), first(df, "Name").alias("name"), first(df, "Description").alias("description"),
        first(df, "Abstraction").alias("abstraction"), first(df, "Status").alias("status"), first(df, "Likelihood Of Attack").alias("likelihood"), first(df, "Typical Severity").alias("severity"),
        *[tx.parse_list(first(df, name)).alias(c) for name, c in (("Resources Required", "resources"), ("Indicators", "indicators"), ("Mitigations", "mitigations"), ("Example Instances", "examples"), ("Alternate Terms", "alternate_terms"))],
        tx.parse_list(first(df, "Prerequisites")).alias("prerequisites"), tx.parse_skills(first(df, "Skills Required")).alias("skills"), tx.parse_consequences(first(df, "Consequences")).alias("consequences"),
        tx.parse_execution_flow(first(df, "Execution Flow")).alias("execution_flow"), tx.parse_related_patterns(first(df, "Related Attack Patterns")).alias("related"),
        tx.related_weaknesses(first(df, "Related Weaknesses"), fixed=True).alias("weaknesses"), tx.parse_taxonomy(first(df, "Taxonomy Mappings")).alias("taxonomy"), tx.taxonomy_attack_ids(first(df, "Taxonomy Mappings")).alias("techniques"),
    )
    return _first_of(rows.where("capec_id <> 'CAPEC-'"), "capec_id")


def pattern_edges(patterns: DataFrame) -> DataFrame:
    """Edges (src, type, dst) of pattern_catalogue's rows to other patterns, weaknesses and techniques."""
    related = patterns.select(F.col("capec_id").alias("src"), F.explode("related").alias("r")).select("src", "r.type", F.col("r.capec_id").alias("dst"))
    ends = lambda c, kind: patterns.select(F.col("capec_id").alias("src"), F.lit(kind).alias("type"), F.explode(c).alias("dst"))
    return related.unionByName(ends("weaknesses", "EXPLOITS")).unionByName(ends("techniques", "MAPPED_TO")).distinct()


def kev_edges(catalogue: DataFrame) -> DataFrame:
    """(src, type, dst): known exploited vulnerabilities to their weaknesses."""
    return catalogue.select(F.col("cve_id").alias("src"), F.lit("HAS_WEAKNESS").alias("type"), F.explode("cwes").alias("dst")).distinct()


def enables_edges(mapping: DataFrame, vulnerabilities: DataFrame, techniques: DataFrame) -> DataFrame:
    """(src, type, dst): vulnerabilities to the techniques that they enable, where both are known."""
    edges = mapping.join(vulnerabilities.select("cve_id"), "cve_id", "left_semi").join(techniques.select("technique_id"), "technique_id", "left_semi")
    return edges.select(F.col("cve_id").alias("src"), F.lit("ENABLES").alias("type"), F.col("technique_id").alias("dst")).distinct()


def defence_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, label) of defence techniques and digital artifacts, each once."""
    df = _csv(spark, path)
    node = lambda c, kind, label: df.select(tx.uri_tail(first(df, c)).alias("id"), F.lit(kind).alias("kind"), first(df, label).alias("label"))
    return _labelled(node("def_tech", "defence", "def_tech_label").unionByName(node("def_artifact", "artifact", "def_artifact_label")))


def _labelled(nodes: DataFrame) -> DataFrame:
    return nodes.where("id <> ''").groupBy("id", "kind").agg(F.max("label").alias("label"))


def artifact_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, type, dst): defence techniques to the artifacts that they work on, the relation as the type."""
    df = _csv(spark, path)
    kind = F.upper(F.regexp_replace(F.coalesce(F.nullif(tx.uri_tail(first(df, "def_artifact_rel")), F.lit("")), F.lit("relates")), "-", "_"))
    return df.select(tx.uri_tail(first(df, "def_tech")).alias("src"), kind.alias("type"), tx.uri_tail(first(df, "def_artifact")).alias("dst")).where("src <> '' AND dst <> ''").distinct()


def engagement_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, label) of engagement vulnerabilities and activities, each once."""
    df = _csv(spark, path)
    node = lambda c, kind, label: df.select(first(df, c).alias("id"), F.lit(kind).alias("kind"), first(df, label).alias("label"))
    return _labelled(node("eav_id", "weakness", "eav").unionByName(node("eac_id", "activity", "eac")))


def abbreviations(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(abbreviation, expansion) pairs of a CSV file in the order of its `pos` column: a list of hundreds, for expand_abbreviations."""
    return [(r.abbreviation, r.expansion) for r in _csv(spark, path).selectExpr("CAST(pos AS INT) AS pos", "abbreviation", "expansion").orderBy("pos").collect()]


def relational_query(spark: SparkSession, url: str, sql: str, options: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Rows of a query on a relational store (needs its JDBC driver); split = (column, low, high, tasks) reads by many tasks."""
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if split is None:
        return reader.option("query", sql).load()
    column, low, high, n = split
    return reader.option("dbtable", f"({sql}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()


def defence_edges(spark: SparkSession, path: str) -> DataFrame:
    return defence_rows(_csv(spark, path))


def defence_rows(df: DataFrame) -> DataFrame:
    return df.select(tx.uri_tail(first(df, "def_tech")).alias("src"), F.lit("COUNTERS").alias("type"), tx.uri_tail(first(df, "off_tech_id", "off_tech")).alias("dst")).where("src <> '' AND dst <> ''").distinct()


def engagement_edges(spark: SparkSession, path: str) -> DataFrame:
    return engagement_rows(_csv(spark, path))


def engagement_rows(df: DataFrame) -> DataFrame:
    return df.select(first(df, "eav_id", "eac_id").alias("src"), F.lit("ADDRESSES").alias("type"), first(df, "attack_id").alias("dst"), F.coalesce(first(df, "version").try_cast("int"), F.lit(0)).alias("version")).where("src <> '' AND dst <> ''").distinct()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded texts and pages as (path, content_type, text), cleaned by their type; PDFs are left to a reader of their own."""
    rows = spark.read.format("binaryFile").load(path).select("path", tx.content_type(F.col("path")).alias("content_type"), F.decode("content", "UTF-8").alias("raw"))
    text = F.when(F.col("content_type") == "html", tx.clean_html(F.col("raw"))).when(F.col("content_type") == "markdown", tx.clean_markdown(F.col("raw"))).otherwise(F.col("raw"))
    return rows.where("content_type <> 'pdf'").select("path", "content_type", text.alias("text"))


def verify(spark: SparkSession, path: str, sha256: str) -> bool:
    """Whether a downloaded source has the digest that was announced."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
    return bool(row) and row.d == sha256.lower()
