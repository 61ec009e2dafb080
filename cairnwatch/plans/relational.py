"""Registered queries over texts, graph, quality, snapshots, metrics and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx
from cairnwatch.operators import graph, metrics, quality, snapshot, windows
from cairnwatch.plans import dims
from cairnwatch.plans.derived import derived, derived_sql
from cairnwatch.plans.dims import dim, values
from cairnwatch.plans.scoring import _IDS, TOLD, dealt, docs_of, replaced, table, told

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _digest(df: DataFrame, c) -> DataFrame:
    return df.select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


_TOLD2 = f"SELECT doc_id, text || ' See cve 2021 44228,T1059.001!x [label](u) ![alt](v) `code`' AS text FROM ({TOLD})"


def told2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" See cve 2021 44228,T1059.001!x [label](u) ![alt](v) `code`")))


@query(f"""WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '([.,;!?])([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')) AS t FROM ({_TOLD2})) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x""")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(told2(spark, sf_dir), tx.normalize_ws(F.col("text")))


def _masked(c: str, inside) -> str:
    """An SQL expression on a text in which accented letters count as letters at the edge of a word."""
    return replaced(inside(replaced(c, False)), True)


def _abbr(c: str) -> str:
    for a, e in dims.ABBREVIATION:
        c = f"regexp_replace({c}, '\\b{a}\\b', '{e}', 'g')"
    return c


@query(f"WITH x AS (SELECT doc_id, {_masked('lower(text)', _abbr)} AS t FROM ({_TOLD2})) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x")
def expand_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(told2(spark, sf_dir), tx.expand_abbreviations(F.col("text"), dims.ABBREVIATION))


_CVE = lambda c: f"regexp_replace({c}, '(?i)\\bcve[- \\t\\n]?([0-9]{{4}})[- \\t\\n]?([0-9]{{1,7}})\\b', 'CVE-\\1-\\2', 'g')"


@query(f"WITH x AS (SELECT doc_id, {_masked('text', _CVE)} AS t FROM ({_TOLD2})) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x")
def normalize_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(told2(spark, sf_dir), tx.normalize_cve(F.col("text")))


_MD = "text"
for _p, _b in ((r"(?s)```.*?```", ""), (r"`([^`]+)`", r"\1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", r"\1")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_b}', 'g')"


@query(f"WITH x AS (SELECT doc_id, {_MD} AS t FROM ({_TOLD2})) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(told2(spark, sf_dir), tx.clean_markdown(F.col("text")))


@query("""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, length(t) AS n, md5(t) AS digest FROM x""")
def clean_html_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.clean_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("""WITH x AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) > 25000 THEN greatest(length(text) - 500, 1) ELSE 1 END, 4500)) AS s, text FROM documents)
SELECT doc_id, s // 4500 AS chunk_id, s AS start, least(s + CASE WHEN length(text) > 25000 THEN 5000 ELSE length(text) END, length(text)) AS end_,
       md5(substr(text, s + 1, CASE WHEN length(text) > 25000 THEN 5000 ELSE length(text) END)) AS digest FROM x""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end_"), F.md5("c.text").alias("digest"))


@query("""WITH x AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) > 25000 THEN greatest(length(text) - 500, 1) ELSE 1 END, 4500)) AS s, length(text) AS n FROM documents),
c AS (SELECT doc_id, CASE WHEN n > 25000 THEN least(s + 5000, n) - s ELSE n END AS size FROM x)
SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(avg(size), 4) AS avg_size, CAST(sum(size) AS BIGINT) AS total FROM c""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c")).withColumn("size", F.col("c.end") - F.col("c.start"))
    return rows.agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("size"), 4).alias("avg_size"), F.sum("size").alias("total"))


#: Words that no keyword is made of.
_KEYWORD_STOP = [
    "the", "and", "for", "with", "this", "that", "from", "their", "they", "have", "has", "been", "were", "when", "where", "will", "what", "who", "how",
    "some", "such", "than", "then", "these", "those", "there", "about",
]


@query(f"""WITH {derived_sql('technique')}, s(w) AS (SELECT unnest([{', '.join(f"'{w}'" for w in _KEYWORD_STOP)}])),
w AS (SELECT technique_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS x FROM technique UNION ALL SELECT technique_id, unnest(regexp_extract_all(lower(string_split(description, '.')[1]), '[a-z0-9]+')) FROM technique),
p AS (SELECT technique_id, lower(name) AS k FROM technique
  UNION SELECT technique_id, trim(x) FROM (SELECT technique_id, unnest(string_split_regex(lower(name), '[/()\\[\\]{{}}:]')) AS x FROM technique) WHERE contains(trim(x), ' ')
  UNION SELECT technique_id, x FROM w WHERE length(x) > 3 AND x NOT IN (SELECT w FROM s))
SELECT technique_id, k AS keyword FROM p""")
def keyword_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, first = F.lower("name"), F.lower(F.concat("name", F.lit(" "), tx.first_sentences(F.col("description"))))
    parts = F.filter(F.transform(F.split(name, r"[/()\[\]{}:]"), lambda p: F.trim(p)), lambda p: p.contains(" "))
    words = F.filter(F.regexp_extract_all(first, F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 3) & ~w.isin(_KEYWORD_STOP))
    return derived(spark, sf_dir, "technique").select("technique_id", F.explode(F.array_distinct(F.concat(F.array(name), parts, words))).alias("keyword"))


@query("SELECT doc_id, substr(text, greatest(instr(text, 'with') - 50, 1), instr(text, 'with') + 4 + 50 - greatest(instr(text, 'with') - 50, 1)) AS snippet FROM documents WHERE contains(text, 'with')")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", tx.snippet(F.col("text"), F.lit("with")).alias("snippet")).where("snippet IS NOT NULL")


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN 'n/a' ELSE '2024-13-45' END AS raw FROM orders)
SELECT o_orderkey, raw, coalesce(CASE WHEN regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN strftime(try_strptime(raw, '%Y-%m-%d'), '%Y-%m-%d') WHEN regexp_matches(raw, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN strftime(try_strptime(raw, '%m/%d/%Y'), '%Y-%m-%d') END, '') AS iso FROM x""")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.concat_ws("/", F.month(d), F.day(d), F.year(d))).when(F.col("o_orderkey") % 4 == 2, "n/a").otherwise("2024-13-45")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("iso", tx.date_normalise(F.col("raw")))


_PACKED = "'::' || (p_partkey % 900) || '::' || p_brand || ' ::' || (p_size) || '::' || (p_partkey % 77) || '::'"


@query(f"WITH x AS (SELECT p_partkey, {_PACKED} AS s FROM part) SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(s, '::'), lambda p: trim(p)), lambda p: p <> ''), ',') AS parts FROM x")
def parse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.parse_list(F.expr(_PACKED)), ",").alias("parts"))


_WEAK = "'::' || (p_partkey % 900) || '::' || p_size || '::' || (p_partkey % 77) || '::' || (p_partkey % 31) || '::'"


@query(f"WITH x AS (SELECT p_partkey, {_WEAK} AS s FROM part) SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, '::([0-9]+)::', 1), lambda i: 'CWE-' || i), ',') AS lossy, array_to_string(list_transform(list_filter(string_split(s, '::'), lambda p: p <> ''), lambda i: 'CWE-' || i), ',') AS complete FROM x")
def parse_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr(_WEAK)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.related_weaknesses(s), ",").alias("lossy"), F.array_join(tx.related_weaknesses(s, fixed=True), ",").alias("complete"))


_URI = "'http://example.org/onto' || CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '/x/' END || p_brand"


@query(f"SELECT p_partkey, regexp_extract({_URI}, '([^/#]*)$', 1) AS tail FROM part")
def uri_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.uri_tail(F.expr(_URI)).alias("tail"))


@query(f"""WITH {derived_sql('edge')}, u AS (SELECT src AS a, dst AS b FROM edge WHERE type IN ('RELATED_TO', 'SIMILAR_TO') UNION SELECT dst, src FROM edge WHERE type IN ('RELATED_TO', 'SIMILAR_TO'))
SELECT DISTINCT a, b, 0.6::DOUBLE AS confidence FROM u WHERE a <> b""")
def related_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_1hop(derived(spark, sf_dir, "edge"), ["RELATED_TO", "SIMILAR_TO"])


_TYPES = ["RELATED_TO", "SIMILAR_TO", "MAPPED_TO", "USES"]


@query(f"""WITH {derived_sql('edge')}, e AS (SELECT DISTINCT src || '|' || type || '|' || dst AS eid, src, dst FROM edge WHERE type IN ('RELATED_TO', 'SIMILAR_TO', 'MAPPED_TO', 'USES')),
u AS (SELECT eid, src AS a, dst AS b FROM e UNION SELECT eid, dst, src FROM e)
SELECT a, b FROM u WHERE a <> b UNION SELECT x.a, y.b FROM u x JOIN u y ON x.b = y.a AND x.eid <> y.eid WHERE x.a <> y.b""")
def related_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_2hop(derived(spark, sf_dir, "edge"), _TYPES)


@query(f"""WITH {derived_sql('technique', 'technique_tactic', 'edge')}
SELECT t.technique_id, t.name, coalesce((SELECT string_agg(DISTINCT tactic, ',' ORDER BY tactic) FROM technique_tactic x WHERE x.technique_id = t.technique_id), '') AS tactics,
coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edge e WHERE e.src = t.technique_id AND type = 'MITIGATED_BY'), '') AS mitigations FROM technique t""")
def enrich_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.enrich(derived(spark, sf_dir, "technique"), derived(spark, sf_dir, "technique_tactic"), derived(spark, sf_dir, "edge"))


@query(f"""WITH {values('technique')}, r AS (SELECT p_partkey, ({_IDS})[p_partkey % 24 + 1] AS technique_id, CASE WHEN p_size > 25 THEN p_name END AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS description FROM part)
SELECT p_partkey, technique_id, CASE WHEN coalesce(r.name, '') = '' THEN t.name ELSE r.name END AS name, CASE WHEN coalesce(r.description, '') = '' THEN t.description ELSE r.description END AS description FROM r LEFT JOIN technique t USING (technique_id)""")
def projection_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.element_at(F.array(*map(F.lit, _IDS)), (F.col("p_partkey") % 24 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.alias("technique_id"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("description"))
    return graph.fill(rows, dim(spark, "technique")).select("p_partkey", "technique_id", "name", "description")


_KIND = "CASE WHEN regexp_matches({0}, '^T[0-9]+') THEN 'technique' WHEN {0} LIKE 'CVE-%' THEN 'cve' WHEN {0} LIKE 'CWE-%' THEN 'cwe' WHEN {0} LIKE 'CAPEC-%' THEN 'capec' WHEN {0} LIKE 'S%' THEN 'software' WHEN {0} LIKE 'G%' THEN 'group' WHEN {0} LIKE 'M%' THEN 'mitigation' ELSE 'unknown' END"


@query(f"""WITH {derived_sql('edge')}, u AS (SELECT src AS technique_id, dst AS other, type FROM edge UNION SELECT dst, src, type FROM edge),
k AS (SELECT DISTINCT technique_id, type, other, {_KIND.format('other')} AS other_kind FROM u WHERE regexp_matches(technique_id, '^T[0-9]'))
SELECT technique_id, other, type, other_kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY other_kind, other, type) AS rank FROM k WHERE other_kind IN ('technique', 'capec', 'cve', 'software')) WHERE rank <= 15""")
def relationships_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relationships(derived(spark, sf_dir, "edge"))


@query(f"""WITH {derived_sql('technique', 'edge')}, u AS (SELECT src AS a, dst AS b FROM edge WHERE type IN ('RELATED_TO', 'SIMILAR_TO') UNION SELECT dst, src FROM edge WHERE type IN ('RELATED_TO', 'SIMILAR_TO')),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT DISTINCT a, b FROM u WHERE a <> b AND regexp_matches(b, '^T[0-9]')))
SELECT technique_id, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM r WHERE a = technique_id AND r <= 5), '') AS similar, (SELECT count(DISTINCT dst) FROM edge WHERE src = technique_id AND type = 'MITIGATED_BY') AS n_mitigations FROM technique""")
def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.context(derived(spark, sf_dir, "technique"), derived(spark, sf_dir, "edge"))


@query(f"""WITH {values('edge')}, m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'CAPEC-[0-9]+'))) AS src FROM ({TOLD}))
SELECT DISTINCT doc_id, src AS capec_id, dst AS technique_id, 0.8::DOUBLE AS confidence FROM m JOIN edge USING (src) WHERE type IN ('MAPPED_TO', 'SIMILAR_TO')""")
def capec_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capec_mentions(told(spark, sf_dir), dim(spark, "edge"))


@query(f"""WITH {derived_sql('technique', 'capec')}, a AS (SELECT DISTINCT capec_id AS a, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM capec), b AS (SELECT DISTINCT technique_id AS b, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM technique)
SELECT a, b, count(*) AS n_common FROM a JOIN b USING (w) GROUP BY a, b HAVING count(*) >= 2""")
def capec_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = derived(spark, sf_dir, "capec").withColumnRenamed("capec_id", "id"), derived(spark, sf_dir, "technique").select(F.col("technique_id").alias("id"), "name")
    return graph.name_similarity(left, right)


@query(f"""WITH {derived_sql('technique', 'capec', 'edge')}, n AS (SELECT technique_id AS id FROM technique UNION SELECT capec_id FROM capec)
SELECT DISTINCT src, type, dst FROM edge WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived(spark, sf_dir, "technique").select(F.col("technique_id").alias("id")).unionByName(derived(spark, sf_dir, "capec").select(F.col("capec_id").alias("id")))
    return graph.build_edges(derived(spark, sf_dir, "edge"), nodes)


@query(f"""WITH {derived_sql('technique_tactic')}, p(phase) AS (VALUES ('execution'), ('initial-access'), ('Impact'))
SELECT technique_id, tactic, shortname = phase AS by_shortname FROM technique_tactic JOIN p ON phase = shortname OR phase = tactic""")
def tactic_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = derived(spark, sf_dir, "technique_tactic"), spark.createDataFrame([("execution",), ("initial-access",), ("Impact",)], "phase string")
    by = lambda c: t.join(p, t[c] == p["phase"])
    return by("shortname").select("technique_id", "tactic", F.lit(True).alias("by_shortname")).unionByName(by("tactic").where("phase <> shortname").select("technique_id", "tactic", F.lit(False).alias("by_shortname")))


#: Line items as results: some without fields, some with bad ones.
_RESULTS = f"""SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 'X12' WHEN l_partkey % 50 = 2 THEN 'T9999' WHEN l_partkey % 50 = 3 THEN 'T1059.009' ELSE ({_IDS})[l_partkey % 24 + 1] END AS technique_id,
CASE WHEN l_suppkey % 40 = 0 THEN NULL ELSE l_discount * 11 END AS confidence, CASE WHEN l_suppkey % 30 = 1 THEN NULL WHEN l_suppkey % 30 = 2 THEN 'magic' ELSE 'rule_based+bm25' END AS method, CASE WHEN l_partkey % 20 = 5 THEN 'CVE-20-1' WHEN l_partkey % 20 = 6 THEN 'CVE-2020-1' END AS cve_id FROM lineitem"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    ids = F.element_at(F.array(*map(F.lit, _IDS)), (p % 24 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"),
        F.when(p % 50 == 0, None).when(p % 50 == 1, "X12").when(p % 50 == 2, "T9999").when(p % 50 == 3, "T1059.009").otherwise(ids).alias("technique_id"),
        F.when(s % 40 == 0, None).otherwise(F.col("l_discount") * 11).alias("confidence"), F.when(s % 30 == 1, None).when(s % 30 == 2, "magic").otherwise("rule_based+bm25").alias("method"),
        F.when(p % 20 == 5, "CVE-20-1").when(p % 20 == 6, "CVE-2020-1").alias("cve_id"),
    )


_CHECKED = f"""WITH {values('technique')}, r AS ({_RESULTS}), i AS (
SELECT doc_id, line, 'missing technique_id' AS issue FROM r WHERE technique_id IS NULL UNION ALL SELECT doc_id, line, 'missing confidence' FROM r WHERE confidence IS NULL UNION ALL SELECT doc_id, line, 'missing method' FROM r WHERE method IS NULL
UNION ALL SELECT doc_id, line, 'bad technique_id' FROM r WHERE NOT regexp_matches(technique_id, '^T[0-9]+') UNION ALL SELECT doc_id, line, 'unknown technique_id' FROM r WHERE regexp_matches(technique_id, '^T[0-9]+') AND technique_id NOT IN (SELECT technique_id FROM technique)
UNION ALL SELECT doc_id, line, 'confidence out of range' FROM r WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT doc_id, line, 'unknown method' FROM r WHERE method = 'magic' UNION ALL SELECT doc_id, line, 'bad cve_id' FROM r WHERE cve_id = 'CVE-20-1')"""


@query(_CHECKED + " SELECT * FROM i")
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_results(results(spark, sf_dir), dim(spark, "technique"), ["doc_id", "line"])


@query(_CHECKED + " SELECT issue, count(*) AS n, (SELECT count(*) FROM r) AS total, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) AS rate FROM i GROUP BY issue")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return quality.metrics(rows, quality.check_results(rows, dim(spark, "technique"), ["doc_id", "line"]))


@query(_CHECKED + """, c AS (SELECT doc_id % 100 AS key, doc_id AS seq, doc_id IN (SELECT doc_id FROM i) AS bad FROM (SELECT DISTINCT doc_id FROM r)), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM c),
t AS (SELECT key, count(*) AS n, count(*) FILTER (bad AND r <= 10) AS recent, count(*) FILTER (bad AND r > 10) AS previous FROM o WHERE r <= 20 GROUP BY key)
SELECT key, recent, previous, CASE WHEN n <= 10 THEN 'insufficient_data' WHEN recent < previous THEN 'improving' WHEN recent > previous THEN 'worsening' ELSE 'stable' END AS trend FROM t""")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    found = quality.check_results(rows, dim(spark, "technique"), ["doc_id", "line"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    checks = rows.select("doc_id").distinct().join(found, "doc_id", "left")
    return quality.trend(checks.select((F.col("doc_id") % 100).alias("key"), F.col("doc_id").alias("seq"), F.coalesce("issues", F.lit(0)).alias("issues")))


@query(_CHECKED + " SELECT doc_id, count(*) AS n, string_agg(line || ':' || issue, ';' ORDER BY line || ':' || issue) AS issues FROM i GROUP BY doc_id")
def issues_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.check_results(results(spark, sf_dir), dim(spark, "technique"), ["doc_id", "line"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "line", "issue"))), ";").alias("issues"))


@query(f"WITH r AS ({_RESULTS}) SELECT doc_id, technique_id, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_ids(results(spark, sf_dir), ["doc_id", "technique_id"])


@query(f"""WITH r AS ({_RESULTS}) SELECT DISTINCT doc_id, technique_id, split_part(technique_id, '.', 1) AS parent FROM r x WHERE contains(technique_id, '.')
AND NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND y.technique_id = split_part(x.technique_id, '.', 1))""")
def orphan_subtechniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(results(spark, sf_dir), ["doc_id"])


@query(f"""WITH {derived_sql('edge')}, k AS (SELECT src, type, dst, {_KIND.format('src')} AS src_kind, {_KIND.format('dst')} AS dst_kind FROM edge), ok(type, a, b) AS (VALUES {', '.join(map(str, quality.ALLOWED))})
SELECT src, type, dst, src_kind, dst_kind FROM k WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.type = k.type AND a = src_kind AND b = dst_kind)""")
def relationship_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_relationships(derived(spark, sf_dir, "edge"), spark.createDataFrame(quality.ALLOWED, "type string, src_kind string, dst_kind string"))


_OPS = "SELECT user_id AS entity_id, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN NULL ELSE 'update' END AS operation, ts, CAST(event_id % 7 AS INTEGER) AS version, event_id AS seq FROM events"


@query(f"""WITH o AS (SELECT *, lag(operation) OVER w AS prev, lag(version) OVER w AS before FROM ({_OPS}) WHERE operation IS NOT NULL AND ts IS NOT NULL AND entity_id IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq))
SELECT entity_id, seq, 'after delete' AS issue FROM o WHERE prev = 'delete' AND operation <> 'create' UNION ALL SELECT entity_id, seq, 'version gap' FROM o WHERE version - before > 1
UNION ALL SELECT entity_id, seq, 'missing fields' FROM ({_OPS}) WHERE operation IS NULL OR ts IS NULL OR entity_id IS NULL""")
def temporal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return quality.temporal_coherence(e.select(F.col("user_id").alias("entity_id"), F.expr("CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN NULL ELSE 'update' END").alias("operation"), "ts", (F.col("event_id") % 7).cast("int").alias("version"), F.col("event_id").alias("seq")))


_OLD = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0"
_NEW = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    seg = F.when(F.col("c_custkey") % 7 == 0, "CHANGED").when(F.col("c_custkey") % 13 == 0, None).otherwise(F.col("c_mktsegment"))
    return c.where("c_custkey % 11 <> 0"), c.where("c_custkey % 5 <> 0").withColumn("c_mktsegment", seg)


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'new' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR coalesce(a.c_mktsegment, '') <> coalesce(b.c_mktsegment, '') OR a.c_name <> b.c_name OR a.c_nationkey <> b.c_nationkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.diff(*_snapshots(spark, sf_dir), "c_custkey")


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_name, a.c_name) AS c_name, coalesce(b.c_nationkey, a.c_nationkey) AS c_nationkey, coalesce(b.c_mktsegment, a.c_mktsegment) AS c_mktsegment FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.merge(*_snapshots(spark, sf_dir), "c_custkey")


@query("""SELECT c_custkey, md5('{"c_custkey": ' || c_custkey || ', "c_mktsegment": ' || CASE WHEN c_custkey % 13 = 0 THEN 'null' ELSE '"' || c_mktsegment || '\\u00e9"' END || ', "c_nationkey": ' || c_nationkey || '}') AS hash FROM customer""")
def entity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes by which changes are told; a stored hash, raw data and times don't count."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.concat("c_mktsegment", F.lit("\u00e9"))).alias("c_mktsegment"), "c_nationkey", F.md5("c_name").alias("entity_hash"), F.col("c_name").alias("raw_data"), F.current_timestamp().alias("updated_at"))
    return rows.select("c_custkey", snapshot.entity_hash(rows).alias("hash"))


def _rate(seconds: int, limit: int) -> str:
    return f"SELECT user_id, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS bucket, count(*) AS n, greatest(count(*) - {limit}, 0) AS rejected FROM events GROUP BY ALL"


@query(_rate(60, 1))
def rate_window_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_window(table(spark, sf_dir, "events"), 60, 1)


@query(_rate(3600, 2))
def rate_window_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_window(table(spark, sf_dir, "events"), 3600, 2)


@query("""SELECT event_id, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, row_number() OVER w AS place, row_number() OVER w <= 1 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) ORDER BY ts, event_id)""")
def rate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_verdicts(table(spark, sf_dir, "events"), 3600, 1)


@query("""WITH e AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'shared' ELSE 'file' END AS tier FROM events)
SELECT event_id, tier FROM e WHERE epoch(ts) + CASE tier WHEN 'memory' THEN 300 WHEN 'shared' THEN 86400 ELSE 604800 END < epoch(TIMESTAMP '2024-01-15 00:00:00')""")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.expr("CASE event_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'shared' ELSE 'file' END").alias("tier"))
    return windows.ttl_expired(e, F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))).select("event_id", "tier")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_state(table(spark, sf_dir, "events"), "user_id", ["event_type", "event_id"], ["ts", "event_id"])


def _usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_discount").alias("score"))
    marks = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("user_id"), F.col("s_suppkey").alias("bookmark_id"))
    return users, jobs, rows, marks


_USAGE = """u AS (SELECT c_custkey AS user_id FROM customer), j AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderstatus AS status FROM orders),
r AS (SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS result_id, l_discount AS score FROM lineitem), b AS (SELECT s_suppkey * 3 AS user_id, s_suppkey AS bookmark_id FROM supplier)"""


@query(f"""WITH {_USAGE} SELECT u.user_id, count(j.job_id) AS n_jobs, count(*) FILTER (status = 'F') AS n_done, count(DISTINCT result_id) AS n_results, round(avg(score), 6) AS avg_score, count(bookmark_id) AS n_bookmarks
FROM u LEFT JOIN j ON j.user_id = u.user_id LEFT JOIN r ON r.job_id = j.job_id LEFT JOIN b ON b.user_id = u.user_id GROUP BY u.user_id""")
def user_stats_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.user_stats(*_usage(spark, sf_dir), fan_out=True)


@query(f"""WITH {_USAGE}, x AS (SELECT user_id, count(*) AS n_jobs, count(*) FILTER (status = 'F') AS n_done FROM j GROUP BY user_id), y AS (SELECT user_id, count(DISTINCT result_id) AS n_results, round(avg(score), 7) AS avg_score FROM j JOIN r USING (job_id) GROUP BY user_id), z AS (SELECT user_id, count(*) AS n_bookmarks FROM b GROUP BY user_id)
SELECT user_id, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_done, 0) AS n_done, coalesce(n_results, 0) AS n_results, avg_score, coalesce(n_bookmarks, 0) AS n_bookmarks FROM u LEFT JOIN x USING (user_id) LEFT JOIN y USING (user_id) LEFT JOIN z USING (user_id)""")
def user_stats_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.user_stats(*_usage(spark, sf_dir), fan_out=False)


@query("""WITH f AS (SELECT ts FROM events WHERE event_type = 'click'), t AS (SELECT max(ts) AS cut FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20')
SELECT count(*) AS n, count(*) >= 50 AS enough FROM f, t WHERE ts > coalesce(cut, TIMESTAMP '1970-01-01')""")
def feedback_since_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.since_last(e.where("event_type = 'click'").select("ts"), e.where("event_type = 'purchase' AND ts < '2024-01-20'").select("ts"), 50)


@query("""SELECT lang, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative, count(*) FILTER (toxic = 1) AS highlighted, count(*) >= 10 AS enough FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("lang").agg(n(F.col("quality") == 1).alias("positive"), n(F.col("quality") == 0).alias("negative"), n(F.col("toxic") == 1).alias("highlighted"), (F.count(F.lit(1)) >= 10).alias("enough"))


_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]


@query("WITH b(le, v) AS (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in _BOUNDS) + ", ('+Inf', 'infinity'::DOUBLE)) SELECT event_type, le, count(*) FILTER (value <= v) AS n FROM events, b GROUP BY event_type, le")
def histogram_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "value", _BOUNDS, ["event_type"])


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) FILTER (value <= 50) AS misses, round(count(*) FILTER (value > 50)::DOUBLE / count(*), 6) AS hit_rate, CAST(sum(CAST(length(props) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY event_type""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).alias("hit"), F.length("props").alias("size"))
    return metrics.cache_stats(e, "hit", "size", "event_type")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1), o AS (SELECT *, CAST(epoch(start) / 3600 AS BIGINT) - row_number() OVER (ORDER BY start) AS island FROM w WHERE bad::DOUBLE / n > 0.05)
SELECT min(start) AS start, max(start) AS last, count(*) AS n_windows, round(CAST(sum(bad) AS DOUBLE) / sum(n), 6) AS ratio FROM o GROUP BY island HAVING count(*) >= 2""")
def error_ratio_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return metrics.alert_ratio(e, F.col("event_type") == "error", "1 hour", 0.05, 2)


@query("""WITH t AS (SELECT l_partkey, count(*) AS calls, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, calls, round(total, 4) AS total, round(100 * total / (SELECT sum(total) FROM t), 2) AS share FROM t ORDER BY total DESC, l_partkey LIMIT 10""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.share_of_total(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice")


@query(f"""WITH {values('technique')}, r AS ({_RESULTS}) SELECT technique_id, name, count(*) AS n, count(DISTINCT doc_id) AS n_docs, max(confidence) AS best FROM r JOIN technique USING (technique_id) GROUP BY ALL ORDER BY n DESC, technique_id LIMIT 10""")
def top_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(results(spark, sf_dir).select("doc_id", "technique_id", "confidence"), "doc_id").join(dim(spark, "technique").select("technique_id", "name"), "technique_id")
    return rows.groupBy("technique_id", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.max("confidence").alias("best")).orderBy(F.col("n").desc(), "technique_id").limit(10)


@query(f"WITH {derived_sql('technique', 'technique_tactic')} SELECT DISTINCT technique_id, name FROM technique JOIN technique_tactic USING (technique_id) WHERE lower(tactic) = 'persistence' OR lower(shortname) = 'persistence'")
def tactic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "technique_tactic").where((F.lower("tactic") == "persistence") | (F.lower("shortname") == "persistence"))
    return derived(spark, sf_dir, "technique").join(t, "technique_id", "left_semi").select("technique_id", "name")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN '#ff6666' WHEN l_discount * 10 >= 0.5 THEN '#ffb366' WHEN l_discount * 10 >= 0.3 THEN '#ffff99' ELSE '#ffffdd' END AS color FROM lineitem")
def color_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.color(F.col("l_discount") * 10).alias("color"))


@query(f"""WITH r AS (SELECT doc_id, technique_id, max(confidence) AS c FROM ({_RESULTS}) WHERE technique_id IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)
SELECT doc_id, count(*) AS n, string_agg(technique_id || ':' || CAST(round_even(c * 100, 0) AS INTEGER) || '%', ',' ORDER BY technique_id) AS cells FROM r GROUP BY doc_id""")
def navigator_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = results(spark, sf_dir).where("technique_id IS NOT NULL AND confidence IS NOT NULL").groupBy("doc_id", "technique_id").agg(F.max("confidence").alias("c"))
    cell = F.struct("technique_id", F.concat("technique_id", F.lit(":"), tx.percent(F.col("c"))).alias("s"))
    return by.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["s"]), ",").alias("cells"))


_QUERIES = "CASE o_orderkey % 9 WHEN 0 THEN ' select 1' WHEN 1 THEN 'INSERT x' WHEN 2 THEN 'match (n) create (m)' WHEN 3 THEN 'MATCH (n) DELETE n' WHEN 4 THEN 'MATCH (n) SET n.x = 1' WHEN 5 THEN 'MATCH (n) RETURN n' WHEN 6 THEN 'MERGE (n)' WHEN 7 THEN '' ELSE 'CALL x' END"


@query(f"""WITH q AS (SELECT o_orderkey, upper(trim({_QUERIES})) AS q FROM orders) SELECT o_orderkey, CASE WHEN q = '' THEN 'unknown' WHEN q LIKE 'SELECT%' THEN 'select' WHEN q LIKE 'INSERT%' THEN 'insert' WHEN q LIKE 'MATCH%CREATE%' THEN 'match_create' WHEN q LIKE 'MATCH%DELETE%' THEN 'match_delete' WHEN q LIKE 'MATCH%SET%' THEN 'match_update' WHEN q LIKE 'MATCH%' THEN 'match' WHEN q LIKE 'MERGE%' THEN 'merge' ELSE 'other' END AS query_type FROM q""")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.query_type(F.expr(_QUERIES)).alias("query_type"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'))) || '_' || substr(md5('0.2_10_True_bm25,kev,rule_based'), 1, 8) AS cache_key FROM documents")
def result_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", tx.cache_key(F.col("text"), 0.2, 10, True, ["rule_based", "kev", "bm25"]).alias("cache_key"))


@query("""SELECT o_orderkey AS job_id, o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_results, coalesce((SELECT string_agg(l_linenumber || '/' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS results FROM orders""")
def job_metrics_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_returnflag")
    rows = metrics.job_bundle(jobs, {"results": parts})
    return rows.select("job_id", "status", F.when(F.col("results").isNull(), 0).otherwise(F.size("results")).cast("long").alias("n_results"), F.coalesce(F.array_join(F.transform("results", lambda r: F.concat_ws("/", r["l_linenumber"], r["l_returnflag"])), ","), F.lit("")).alias("results"))


@query("""WITH e AS (SELECT event_type AS tier, event_id AS key, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT tier, key FROM e WHERE r <= floor(n * 0.25)""")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), F.col("event_id").alias("key"), F.col("ts").alias("accessed"))
    return metrics.lru_evict(e).select("tier", "key")


_LOADS = "SELECT user_id AS queue, (count(*) * 7 + user_id * 3) % 45 AS jobs, (count(*) + user_id) % 13 AS workers FROM events GROUP BY user_id"


@query(f"""WITH s AS ({_LOADS}), l AS (SELECT *, CASE WHEN workers > 0 THEN jobs::DOUBLE / workers ELSE 'infinity'::DOUBLE END AS per, jobs // 2 AS share FROM s),
w AS (SELECT *, least(10, workers + 1, greatest(2, share)) AS up, greatest(2, least(workers - 1, share + 1)) AS down FROM l)
SELECT queue, jobs, workers, CAST(CASE WHEN per > 3 AND workers < 10 AND up > workers THEN up WHEN per < 1 AND workers > 2 AND down < workers THEN down ELSE workers END AS BIGINT) AS target FROM w""")
def autoscale_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.count(F.lit(1)), F.col("user_id")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n"))
    return windows.autoscale(s.select(user.alias("queue"), ((F.col("n") * 7 + user * 3) % 45).alias("jobs"), ((F.col("n") + user) % 13).alias("workers")))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::INTEGER, ',' ORDER BY l_quantity, l_linenumber) AS highlights FROM lineitem GROUP BY l_orderkey""")
def feedback_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "l_linenumber"))).alias("h"))
    return rows.select("l_orderkey", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_quantity"].cast("int"))), ",").alias("highlights"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'default' ELSE 'low' END AS queue,
CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 15 WHEN o_orderpriority LIKE '3%' THEN 30 ELSE 60 END AS timeout_minutes FROM orders""")
def priority_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    pick = lambda a, b, c: F.when(p.isin("1", "2"), a).when(p == "3", b).otherwise(c)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), "o_orderpriority", pick("high", "default", "low").alias("queue"), pick(15, 30, 60).alias("timeout_minutes"))


@query("SELECT event_type AS component, CASE WHEN bool_and(value < 99.9) THEN 'healthy' ELSE 'degraded' END AS status, count(*) AS checks FROM events GROUP BY event_type")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("component")).agg(F.when(F.bool_and(F.col("value") < 99.9), "healthy").otherwise("degraded").alias("status"), F.count(F.lit(1)).alias("checks"))
