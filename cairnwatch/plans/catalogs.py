"""Registered queries over graph patterns and over catalogue files written from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.operators import patterns
from cairnwatch.operators.patterns import Hop, Pattern
from cairnwatch.plans.scoring import table
from cairnwatch.sources import catalogs as readers
from cairnwatch.sources import rescue
from cairnwatch.sources.shared import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


#: A graph of the tables: kind, table, id; and relations: type, table, source, target. Spark and SQL read the same texts.
_NODES = [("nation", "nation", "'n' || n_nationkey"), ("customer", "customer", "'c' || c_custkey"), ("order", "orders", "'o' || o_orderkey"), ("part", "part", "'p' || p_partkey"), ("supplier", "supplier", "'s' || s_suppkey")]
_EDGES = [
    ("IN", "customer", "'c' || c_custkey", "'n' || c_nationkey"), ("IN", "supplier", "'s' || s_suppkey", "'n' || s_nationkey"), ("PLACED", "orders", "'c' || o_custkey", "'o' || o_orderkey"),
    ("CONTAINS", "lineitem", "'o' || l_orderkey", "'p' || l_partkey"), ("SUPPLIED_BY", "lineitem", "'p' || l_partkey", "'s' || l_suppkey"),
]
_GRAPH = (
    "nodes AS (" + " UNION ALL ".join(f"SELECT {i} AS id, '{k}' AS label FROM {t}" for k, t, i in _NODES) + "), "
    "edges AS MATERIALIZED (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {s} AS src, '{k}' AS type, {d} AS dst FROM {t}" for k, t, s, d in _EDGES) + "))"
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, type, dst) of the tables: a relation a line item, order, customer and supplier."""
    nodes = [table(spark, sf_dir, t).selectExpr(f"{i} AS id", f"'{k}' AS label") for k, t, i in _NODES]
    edges = [table(spark, sf_dir, t).selectExpr(f"{s} AS src", f"'{k}' AS type", f"{d} AS dst") for k, t, s, d in _EDGES]
    for more in nodes[1:]:
        nodes[0] = nodes[0].unionByName(more)
    for more in edges[1:]:
        edges[0] = edges[0].unionByName(more)
    return nodes[0], edges[0]


@query(f"""WITH {_GRAPH} SELECT DISTINCT n.id AS nation, s.id AS supplier FROM nodes n JOIN edges a ON a.dst = n.id AND a.type = 'IN' JOIN nodes c ON c.id = a.src AND c.label = 'customer' JOIN edges b ON b.src = c.id AND b.type = 'PLACED'
JOIN edges d ON d.src = b.dst AND d.type = 'CONTAINS' JOIN edges e ON e.src = d.dst AND e.type = 'SUPPLIED_BY' JOIN nodes s ON s.id = e.dst AND s.label = 'supplier' WHERE n.label = 'nation'""")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n:nation)<-[:IN]-(:customer)-[:PLACED]->()-[:CONTAINS]->()-[:SUPPLIED_BY]->(s:supplier): only the named nodes are carried on."""
    nodes, edges = graph(spark, sf_dir)
    hops = (Hop(("IN",), patterns.IN, label="customer"), Hop(("PLACED",)), Hop(("CONTAINS",)), Hop(("SUPPLIED_BY",), label="supplier", name="supplier"))
    return patterns.match(nodes, edges, Pattern("nation", "nation", hops))


@query(f"""WITH RECURSIVE {_GRAPH}, u AS (SELECT src, dst FROM edges WHERE type IN ('PLACED', 'CONTAINS', 'SUPPLIED_BY')),
r AS (SELECT id AS customer, id AS "at", 0 AS hops FROM nodes WHERE label = 'customer' UNION SELECT customer, dst, hops + 1 FROM r JOIN u ON u.src = r."at" WHERE hops < 3)
SELECT DISTINCT customer, "at" AS reached FROM r WHERE hops > 0""")
def graph_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer)-[:PLACED|CONTAINS|SUPPLIED_BY*1..3]->(reached): all that a customer reaches within three relations."""
    nodes, edges = graph(spark, sf_dir)
    return patterns.match(nodes, edges, Pattern("customer", "customer", (Hop(("PLACED", "CONTAINS", "SUPPLIED_BY"), most=3, name="reached"),)))


@query(f"""WITH {_GRAPH}, e AS (SELECT src AS a, dst AS b FROM edges WHERE type IN ('IN', 'PLACED') UNION SELECT dst, src FROM edges WHERE type IN ('IN', 'PLACED')),
p AS (SELECT a, b FROM e WHERE a LIKE 'o%' UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a WHERE x.a LIKE 'o%' AND x.a <> y.b)
SELECT a AS start, b AS near FROM p JOIN nodes ON nodes.id = a AND label = 'order'""")
def graph_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start:order)-[:IN|PLACED*1..2]-(near), either way."""
    nodes, edges = graph(spark, sf_dir)
    return patterns.match(nodes, edges, Pattern("start", "order", (Hop(("IN", "PLACED"), patterns.BOTH, 2, name="near"),)))


#: For each catalogue: the table that its file is written from, columns, and which rows are written with a field too many.
_FILES = {
    "kev": ("customer", {
        "cveID": "CASE c_custkey % 10 WHEN 0 THEN 'bad' || c_custkey WHEN 1 THEN '2021-' || lpad(CAST(c_custkey AS STRING), 6, '1') ELSE 'cve-2020-' || lpad(CAST(c_custkey AS STRING), 6, '1') END",
        "vendorProject": "c_mktsegment", "product": "c_name || CASE WHEN c_custkey % 25 = 7 THEN ',and,more' ELSE ', \"one\"' END", "vulnerabilityName": "'flaw ' || c_custkey",
        "dateAdded": "CASE c_custkey % 4 WHEN 0 THEN '3/7/2021' WHEN 1 THEN 'March 8, 2021' WHEN 2 THEN '' ELSE '2021-03-09' END", "dueDate": "CASE WHEN c_custkey % 9 = 4 THEN 'soon' ELSE '1 Apr 22' END",
        "knownRansomwareCampaignUse": "CASE WHEN c_custkey % 2 = 0 THEN 'Known' ELSE 'Unknown' END", "cwes": "CASE WHEN c_custkey % 3 = 0 THEN 'CWE-79, CWE-' || c_nationkey WHEN c_custkey % 3 = 1 THEN '22, 78' ELSE '' END",
    }, "c_custkey % 25 = 7"),
    "mapping": ("part", {
        "capability_id": "CASE WHEN p_partkey % 8 = 3 THEN 'none' ELSE 'see CVE-2019-' || (1000 + p_partkey % 700) END", "attack_object_id": "CASE WHEN p_partkey % 6 = 5 THEN 'X' || p_partkey ELSE ' T' || (1000 + p_partkey % 90) END", "attack_object_name": "p_name || CASE WHEN p_partkey % 31 = 2 THEN ',x,y' ELSE '' END",
    }, "p_partkey % 31 = 2"),
    "feed": ("orders", {
        "id": "CASE WHEN o_orderkey % 11 = 3 THEN 'x' ELSE 'CVE-2018-' || (10000 + o_orderkey) END", "published": "'2018-01-01'", "description_en": "o_orderpriority || CASE WHEN o_orderkey % 40 = 9 THEN ',p,q,r,s' ELSE ' \"quoted\", text' END",
        "cvss31_basescore": "CASE WHEN o_orderkey % 13 = 1 THEN '11.5' WHEN o_orderkey % 13 = 2 THEN 'high' WHEN o_orderkey % 13 = 3 THEN '' ELSE '7.5' END", "weaknesses": "'CWE-' || (o_orderkey % 20) || ' cwe-79'",
    }, "o_orderkey % 40 = 9"),
    "patterns": ("part", {
        "'ID": "CASE WHEN p_partkey % 9 = 4 THEN 'none' ELSE CAST(p_partkey AS STRING) END", "Name": "CASE WHEN p_partkey % 12 = 7 THEN ' ' ELSE p_name END", "Prerequisites": "'::' || p_brand || '::' || p_type || '::'",
        "Related Weaknesses": "'::' || p_size || '::285::'", "Taxonomy Mappings": "'TAXONOMY NAME:ATTACK:ENTRY ID:' || (1000 + p_partkey % 50) || ':ENTRY NAME:x' || CASE WHEN p_partkey % 33 = 6 THEN ',1,2,3' ELSE '' END",
    }, "p_partkey % 33 = 6"),
    "defence": ("supplier", {
        "def_tech": "CASE WHEN s_suppkey % 9 = 2 THEN '' ELSE 'http://d3/x#D3-' || s_suppkey END", "off_tech_id": "CASE WHEN s_suppkey % 7 = 3 THEN 'T1' ELSE 'T' || (1000 + s_suppkey % 60) END", "def_artifact": "'a#' || s_nationkey || CASE WHEN s_suppkey % 20 = 8 THEN ',b' ELSE '' END",
    }, "s_suppkey % 20 = 8"),
    "engagement": ("supplier", {
        "eav_id": "CASE WHEN s_suppkey % 9 = 2 THEN '' ELSE 'EAV' || s_suppkey END", "attack_id": "CASE WHEN s_suppkey % 7 = 3 THEN 'G1' ELSE 'T' || (1000 + s_suppkey % 60) || '.001' END", "version": "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'two' ELSE CAST(s_suppkey % 5 AS STRING) END || CASE WHEN s_suppkey % 20 = 8 THEN ',b' ELSE '' END",
    }, "s_suppkey % 20 = 8"),
}


def written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A catalogue's files as made from its table: well-formed ones, and some with rows of too many fields."""
    source, columns, broken = _FILES[kind]
    path = shared_folder(spark, kind)
    rows = table(spark, sf_dir, source)
    cells = [F.expr(e).alias(c) for c, e in columns.items()]
    rows.where(~F.expr(broken)).select(*cells).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    # Without quotes, the commas inside a field part it.
    rows.where(broken).select(*cells).write.mode("append").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)
    return path


def _raw(kind: str) -> str:
    """SQL for the well-formed rows of a catalogue's files, empty fields null as a reader sees them."""
    source, columns, broken = _FILES[kind]
    return f"raw AS (SELECT {', '.join(f'nullif({e}, $$$$) AS {name(c)}' for c, e in columns.items())} FROM {source} WHERE NOT ({broken}))"


def name(column: str) -> str:
    return "c_" + "".join(ch if ch.isalnum() else "_" for ch in column.lower())


_TECHNIQUE = "'T[0-9]{4}([.][0-9]{3})?'"
_OK = {
    "kev": "regexp_full_match(upper(trim(c_cveid)), '(CVE-)?[0-9]{4}-[0-9]{4,7}') AND coalesce(c_duedate, '') <> 'soon'",
    "mapping": f"regexp_matches(c_capability_id, 'CVE-[0-9]+-[0-9]+') AND regexp_full_match(trim(c_attack_object_id), {_TECHNIQUE})",
    "feed": "regexp_full_match(c_id, 'CVE-[0-9]{4}-[0-9]+') AND (c_cvss31_basescore IS NULL OR coalesce(TRY_CAST(c_cvss31_basescore AS DOUBLE) BETWEEN 0 AND 10, false))",
    "patterns": "regexp_matches(c__id, '[0-9]') AND trim(coalesce(c_name, '')) <> ''",
    "defence": f"c_def_tech IS NOT NULL AND regexp_full_match(c_off_tech_id, {_TECHNIQUE})",
    "engagement": f"c_eav_id IS NOT NULL AND regexp_full_match(c_attack_id, {_TECHNIQUE}) AND (c_version IS NULL OR TRY_CAST(c_version AS INTEGER) IS NOT NULL)",
}


def _good(kind: str) -> str:
    return f"WITH {_raw(kind)}, good AS (SELECT * FROM raw WHERE coalesce({_OK[kind]}, false))"


_DATE = "CASE {0} WHEN '3/7/2021' THEN '2021-03-07' WHEN 'March 8, 2021' THEN '2021-03-08' WHEN '1 Apr 22' THEN '2022-04-01' ELSE coalesce({0}, '') END"


@query(f"""{_good('kev')} SELECT CASE WHEN upper(trim(c_cveid)) LIKE 'CVE-%' THEN upper(trim(c_cveid)) ELSE 'CVE-' || trim(c_cveid) END AS cve_id, c_vendorproject AS vendor, c_product AS product, {_DATE.format('c_dateadded')} AS date_added, {_DATE.format('c_duedate')} AS due_date,
c_knownransomwarecampaignuse = 'Known' AS known_ransomware, CASE WHEN c_cwes LIKE 'CWE%' THEN replace(c_cwes, ' ', '') WHEN c_cwes LIKE '22%' THEN 'CWE-22,CWE-78' ELSE '' END AS cwes FROM good""")
def read_kev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = rescue.catalogue(spark, written(spark, sf_dir, "kev"), "kev")
    return rows.select("cve_id", "vendor", "product", "date_added", "due_date", "known_ransomware", F.array_join("cwes", ",").alias("cwes"))


@query(f"{_good('mapping')} SELECT DISTINCT regexp_extract(c_capability_id, 'CVE-[0-9]+-[0-9]+') AS cve_id, trim(c_attack_object_id) AS technique_id, CAST(0.9 AS DOUBLE) AS confidence FROM good")
def read_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.catalogue(spark, written(spark, sf_dir, "mapping"), "mapping")[0]


@query(f"{_good('feed')} SELECT c_id AS cve_id, c_description_en AS description, coalesce(TRY_CAST(c_cvss31_basescore AS DOUBLE), 0) AS cvss31, upper(replace(c_weaknesses, ' ', ',')) AS cwes FROM good")
def read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = rescue.catalogue(spark, written(spark, sf_dir, "feed"), "feed")
    return rows.select("cve_id", "description", "cvss31", F.array_join("cwes", ",").alias("cwes"))


@query(f"{_good('patterns')} SELECT 'CAPEC-' || c__id AS capec_id, c_name AS name, trim(replace(c_prerequisites, '::', ' ')) AS prerequisites, 'CWE-' || string_split(c_related_weaknesses, '::')[2] || ',CWE-285' AS weaknesses, 'T' || regexp_extract(c_taxonomy_mappings, 'ENTRY ID:([0-9]+)', 1) AS techniques FROM good")
def read_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = rescue.catalogue(spark, written(spark, sf_dir, "patterns"), "patterns")
    return rows.select("capec_id", "name", *[F.array_join(c, sep).alias(c) for c, sep in (("prerequisites", " "), ("weaknesses", ","), ("techniques", ","))])


@query(f"{_good('defence')} SELECT regexp_extract(c_def_tech, '#(.*)$', 1) AS src, 'COUNTERS' AS type, c_off_tech_id AS dst FROM good")
def read_defence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.catalogue(spark, written(spark, sf_dir, "defence"), "defence")[0]


@query(f"{_good('engagement')} SELECT c_eav_id AS src, 'ADDRESSES' AS type, c_attack_id AS dst, coalesce(CAST(c_version AS INTEGER), 0) AS version FROM good")
def read_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.catalogue(spark, written(spark, sf_dir, "engagement"), "engagement")[0]


@query(" UNION ALL ".join(f"SELECT * FROM ({_good(k)} SELECT '{k}' AS kind, (SELECT count(*) FROM good) AS good, (SELECT count(*) FROM {_FILES[k][0]} WHERE {_FILES[k][2]}) AS malformed, (SELECT count(*) FROM raw) - (SELECT count(*) FROM good) AS refused)" for k in _FILES))
def read_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each catalogue's rows: read, malformed, or refused by a rule."""
    found = None
    for kind in _FILES:
        raw = rescue.csv_rows(spark, written(spark, sf_dir, kind))
        good, rejected = rescue.parted(raw, rescue.CATALOGUES[kind][0](raw))
        broken = F.array_contains("reasons", "malformed row")
        told = good.agg(F.count(F.lit(1)).alias("good")).crossJoin(rejected.agg(F.count_if(broken).alias("malformed"), F.count_if(~broken).alias("refused")))  # one row each
        part = told.select(F.lit(kind).alias("kind"), "good", "malformed", "refused")
        found = part if found is None else found.unionByName(part)
    return found


_STIX = "'T' || (1000 + p_partkey)"


@query(f"""WITH p AS (SELECT * FROM part WHERE p_partkey % 10 <> 0) SELECT {_STIX} AS src, 'SUBTECHNIQUE_OF' AS type, 'T' || (1000 + CAST(floor(p_partkey / 2) AS BIGINT)) AS dst FROM p WHERE p_partkey % 13 <> 5 AND CAST(floor(p_partkey / 2) AS BIGINT) IN (SELECT p_partkey FROM p WHERE p_partkey % 13 <> 5) AND p_partkey > 1""")
def read_stix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a taxonomy in bundles, a file for each tenth of the parts; objects without an id, and files that are no JSON, are set aside."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    own = F.struct(F.lit("mitre-attack").alias("source_name"), F.expr(_STIX).alias("external_id"))
    ident = F.when(F.col("p_partkey") % 13 != 5, F.concat(F.lit("attack-pattern--"), "p_partkey"))
    technique = F.struct(F.lit("attack-pattern").alias("type"), ident.alias("id"), F.col("p_name").alias("name"), F.array(own).alias("external_references"))
    relation = F.struct(F.lit("relationship").alias("type"), F.concat(F.lit("relationship--"), "p_partkey").alias("id"), F.lit("subtechnique-of").alias("relationship_type"), F.concat(F.lit("attack-pattern--"), "p_partkey").alias("source_ref"), F.concat(F.lit("attack-pattern--"), F.floor(F.col("p_partkey") / 2)).alias("target_ref"))
    objects = F.concat_ws(",", F.to_json(technique), F.when(F.col("p_partkey") > 1, F.to_json(relation)))
    bundles = parts.groupBy((F.col("p_partkey") % 10).alias("file")).agg(F.concat(F.lit('{"objects": ['), F.concat_ws(",", F.collect_list(objects)), F.lit("]}")).alias("value"))
    path = shared_folder(spark, "stix")
    broken = spark.range(1).select(F.lit('{"objects": [').alias("value"))
    bundles.select("value").repartition(9).unionByName(broken).write.option("lineSep", "\n").text(path)
    objects_, _ = rescue.stix(spark, path)
    return readers.stix_edges(objects_)
