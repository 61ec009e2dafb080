"""Registered queries of the scorers and fusions, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.functions import text as tx
from cairnwatch.operators import fusion, scorers
from cairnwatch.plans import dims
from cairnwatch.plans.derived import derived, derived_sql
from cairnwatch.plans.dims import dim, values
from cairnwatch.sources.shared import parts_for, small_batches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of few files over the cores: costly expressions follow, and a row group is one task.

    Large tables have more partitions than cores and are left as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


#: Rows of a table that a task gets where each row becomes a group of its own, or several.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table's rows dealt by the keys of the groups that follow, over as many partitions as its rows ask for: what a task holds doesn't grow."""
    return df.repartition(parts_for(df.sparkSession, df.count(), DEALT_ROWS), *keys)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: What the test documents lack, told by their id: phrases, CVE, CAPEC and technique ids.
TOLD_SQL = """text || CASE doc_id % 5 WHEN 0 THEN ' Spear phishing email over vpn. Beacon to c2.' WHEN 1 THEN ' powershell script, obfuscated and encoded; adversary trojan.' WHEN 2 THEN ' web exploit, then T1059.001 and lateral movement.' ELSE ' scan of CWE-79' END
    || ' cve-202' || (doc_id % 5) || '-' || (1000 + doc_id % 40) || ' CAPEC-' || (100 + doc_id % 15) || ' CVE-2021-44228'"""
TOLD = f"SELECT doc_id, {TOLD_SQL} AS text FROM documents"


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", F.expr(TOLD_SQL).alias("text"))


def _patterns() -> str:
    rows = ((t, tx.word_pattern(ks, java=False)) for t, ks in scorers.grouped(dims.KEYWORD).items())
    return "pattern(technique_id, p) AS (VALUES " + ", ".join(f"('{t}', '{p}')" for t, p in rows) + ")"


def ascii_words(c: str) -> str:
    """A text in which \\b, which knows ASCII letters only, parts words as if it knew the accented ones too."""
    return f"regexp_replace({c}, '[À-ÖØ-öø-ÿ]', '_', 'g')"


def _v1(keys: str = "doc_id") -> str:
    return f"""{_patterns()},
m AS (SELECT {keys}, technique_id, list_transform(regexp_extract_all({ascii_words('text')}, p), lambda x: lower(x)) AS found FROM d CROSS JOIN pattern),
r AS (SELECT {keys}, technique_id, len(found) AS match_count, list_distinct(found) AS keywords FROM m)"""


_V1 = _v1()
_V1_OUT = """SELECT doc_id, technique_id, CAST(match_count AS INTEGER) AS match_count, array_to_string(list_sort(keywords), ',') AS keywords,
    round(least(0.9, CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * len(keywords)), 6) AS confidence FROM r WHERE match_count > 0"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("keywords", F.array_join(F.array_sort("keywords"), ","))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents), {_V1}, c AS ({_V1_OUT})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, technique_id) AS rank FROM c) WHERE rank <= 10""")
def rule_v1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.top_k(_flat(scorers.rule_v1(docs_of(spark, sf_dir), dims.KEYWORD)), 10)


@query(f"""WITH {values('signal')}, d AS ({TOLD}), {_V1},
s AS (SELECT DISTINCT doc_id, technique_id FROM d JOIN signal ON contains(lower(text), phrase)),
k(technique_id, more) AS (VALUES ('T1190', ['web exploit']), ('T1133', ['vpn', 'remote service']), ('T1566', ['phishing']), ('T1059', ['script', 'command interpreter']), ('T1027', ['obfuscated', 'encoded'])),
b AS (SELECT r.doc_id, r.technique_id, r.match_count + CASE WHEN s.doc_id IS NULL THEN 0 ELSE 2 END AS match_count,
      CASE WHEN s.doc_id IS NULL THEN keywords ELSE list_distinct(list_concat(keywords, more)) END AS keywords
      FROM r LEFT JOIN s ON r.doc_id = s.doc_id AND r.technique_id = s.technique_id LEFT JOIN k ON k.technique_id = r.technique_id)
{_V1_OUT.replace('FROM r', 'FROM b')}""")
def rule_v1_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scorers.rule_v1(told(spark, sf_dir), dims.KEYWORD, dims.SIGNAL))


_V2 = f"""{values('technique_keyword', 'context')}, d AS (SELECT doc_id, text, lower(text) AS low FROM ({TOLD})),
kw AS (SELECT doc_id, technique_id, keyword, (length(low) - length(replace(low, keyword, ''))) // length(keyword) AS n, instr(low, keyword) AS first,
       length(low) - instr(reverse(low), reverse(keyword)) - length(keyword) + 2 AS last FROM d JOIN (SELECT DISTINCT technique_id, lower(keyword) AS keyword FROM technique_keyword WHERE length(keyword) > 2) ON contains(low, keyword)),
h AS (SELECT doc_id, technique_id, sum(n) AS n, list(keyword) AS found, min(first) AS first, max(last) AS last FROM kw GROUP BY ALL),
c AS (SELECT doc_id, unnest(techniques) AS technique_id, m FROM (SELECT doc_id, techniques, regexp_extract_all({ascii_words('text')}, '(?i)\\b(?:' || pattern || ')') AS m FROM d CROSS JOIN context) WHERE len(m) > 0),
r AS (SELECT coalesce(h.doc_id, c.doc_id) AS doc_id, coalesce(h.technique_id, c.technique_id) AS technique_id, CAST(coalesce(h.n, len(c.m)) AS BIGINT) AS match_count,
      list_distinct(list_concat(coalesce(h.found, []), coalesce(c.m, []))) AS keywords, h.n AS n_positions, first, last, h.doc_id IS NULL AS context_only,
      CASE WHEN h.doc_id IS NULL THEN 0.8::DOUBLE WHEN c.doc_id IS NOT NULL THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS boost
      FROM h FULL JOIN c ON h.doc_id = c.doc_id AND h.technique_id = c.technique_id),
b AS (SELECT *, len(keywords)::DOUBLE AS u FROM r),
e AS (SELECT *, CASE WHEN context_only THEN 0.3::DOUBLE + 0.05::DOUBLE * u ELSE 0.4::DOUBLE + 0.08::DOUBLE * u + CASE WHEN match_count > u THEN 0.05::DOUBLE * least(match_count / greatest(u, 1::DOUBLE), 3::DOUBLE) ELSE 0 END END AS base FROM b),
f AS (SELECT *, least(base * boost, 0.95::DOUBLE) AS score, (last - first)::DOUBLE / nullif(n_positions - 1, 0) AS gap FROM e),
g AS (SELECT *, round(CASE WHEN n_positions > 1 AND gap < 100 THEN least(score * (1 + 0.1::DOUBLE * (1 - gap / 100)), 0.95::DOUBLE) ELSE score END, 6) AS confidence FROM f)"""


@query(f"WITH {_V2} SELECT doc_id, technique_id, match_count, array_to_string(list_sort(keywords), ',') AS keywords, boost, context_only, confidence FROM g")
def rule_v2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(scorers.rule_v2(told(spark, sf_dir), dims.KEYWORD, dims.CONTEXT))
    return rows.select("doc_id", "technique_id", F.col("match_count").cast("long").alias("match_count"), "keywords", "boost", "context_only", "confidence")


@query(f"""WITH {_V2.replace('FROM d CROSS JOIN context', "FROM d CROSS JOIN context WHERE false")}
SELECT doc_id, technique_id, match_count, array_to_string(list_sort(keywords), ',') AS keywords, confidence FROM g""")
def rule_v2_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(scorers.rule_v2(told(spark, sf_dir), dims.KEYWORD))
    return rows.select("doc_id", "technique_id", F.col("match_count").cast("long").alias("match_count"), "keywords", "confidence")


@query(f"""WITH {values('context')}, d AS ({TOLD})
SELECT doc_id, tactic, len(regexp_extract_all({ascii_words('text')}, '(?i)\\b(?:' || pattern || ')')) AS n_matches, len(techniques) AS n_techniques
FROM d CROSS JOIN context WHERE regexp_matches({ascii_words('text')}, '(?i)\\b(?:' || pattern || ')')""")
def rule_v2_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [F.struct(F.lit(t).alias("tactic"), F.regexp_count("text", F.lit(f"(?i){tx.LEFT}(?:{p})")).cast("long").alias("n_matches"), F.lit(len(ts)).cast("long").alias("n_techniques")) for t, p, ts in dims.CONTEXT]
    rows = told(spark, sf_dir).select("doc_id", F.explode(F.array(*hits)).alias("h")).select("doc_id", "h.*")
    return rows.where("n_matches > 0")


def _contextual_sql() -> str:
    quoted = lambda ks: "[" + ", ".join(f"'{k}'" for k in ks) + "]"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS technique_id, {quoted(ks)} AS more FROM d WHERE " + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in ps) for t, ps, ks in scorers.CONTEXTUAL)
    return f"""s AS ({rows}),
    b AS (SELECT coalesce(x.doc_id, s.doc_id) AS doc_id, coalesce(x.technique_id, s.technique_id) AS technique_id, coalesce(match_count, 0) + CASE WHEN s.doc_id IS NULL THEN 0 ELSE 2 END AS match_count,
      list_distinct(list_concat(coalesce(keywords, []), coalesce(more, []))) AS keywords FROM (SELECT * FROM r WHERE match_count > 0) x FULL JOIN s ON x.doc_id = s.doc_id AND x.technique_id = s.technique_id)"""


_PHRASES = "['an outbound connection', 'beacon back', 'they escalate privilege', 'lateral movement', 'to maintain access', 'bypass detection', 'disable firewall', ''][doc_id % 8 + 1]"


@query(f"""WITH d AS (SELECT doc_id, text || ' ' || {_PHRASES} AS text FROM documents), {_V1}, {_contextual_sql()}
{_V1_OUT.replace('FROM r', 'FROM b')}""")
def rule_v1_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.expr("element_at(array" + _PHRASES.replace("[doc_id % 8 + 1]", "").replace("[", "(").replace("]", ")") + ", cast(doc_id % 8 + 1 as int))")
    docs = docs_of(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), phrases).alias("text"))
    return _flat(scorers.rule_v1(docs, dims.KEYWORD, contexts=scorers.CONTEXTUAL))


@query(f"""WITH d AS ({TOLD}), {_V1}, e AS (SELECT *, len(keywords)::DOUBLE AS u FROM r WHERE match_count > 0)
SELECT doc_id, technique_id, CAST(match_count AS BIGINT) AS match_count, array_to_string(list_sort(keywords), ',') AS keywords,
round(least(0.4::DOUBLE + 0.08::DOUBLE * u + CASE WHEN match_count > u THEN 0.05::DOUBLE * least(match_count / u, 3::DOUBLE) ELSE 0 END, 0.95::DOUBLE), 6) AS confidence FROM e""")
def rule_v2_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(scorers.rule_v2(told(spark, sf_dir), dims.KEYWORD, whole_words=True))
    return rows.select("doc_id", "technique_id", F.col("match_count").cast("long").alias("match_count"), "keywords", "confidence")


_CORPUS = f"""corpus AS (SELECT technique_id AS row_id, lower(name || ' ' || string_split(description, '.')[1] || coalesce(' ' || ks, '')) AS body FROM technique
    LEFT JOIN (SELECT technique_id, string_agg(keyword, ' ' ORDER BY keyword) AS ks FROM technique_keyword GROUP BY technique_id) USING (technique_id))"""


def _words(rows: str, key: str, body: str) -> str:
    return f"(SELECT {key}, unnest(string_split_regex({body}, '[ \\t\\n\\r]+')) AS term FROM {rows})"


_POST = f"""post AS (SELECT row_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY row_id) AS dl FROM {_words('corpus', 'row_id', 'body')} WHERE term <> '' GROUP BY row_id, term),
n AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM (SELECT DISTINCT row_id, dl FROM post)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT doc_id, term, count(*) AS qtf FROM {_words('documents', 'doc_id', 'lower(text)')} WHERE term IN (SELECT term FROM df) GROUP BY doc_id, term)"""
_WEIGHT = "tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


def corpus(spark: SparkSession) -> DataFrame:
    ks = dim(spark, "technique_keyword").groupBy("technique_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), " ").alias("ks"))
    rows = dim(spark, "technique").join(ks, "technique_id", "left")
    return rows.select(F.col("technique_id").alias("row_id"), F.lower(F.concat("name", F.lit(" "), tx.first_sentences(F.col("description")), F.coalesce(F.concat(F.lit(" "), "ks"), F.lit("")))).alias("body"))


def _ranked(scores: DataFrame) -> DataFrame:
    rows = scorers.normalised(scores).withColumnRenamed("row_id", "technique_id")
    return scorers.top_k(rows, 10).select("doc_id", "technique_id", "confidence", "rank")


_RANKED = """c AS (SELECT doc_id, technique_id, round(raw / mx, 6) AS confidence FROM (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS mx FROM s) WHERE mx > 0)
SELECT * FROM (SELECT doc_id, technique_id, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, technique_id) AS rank FROM c WHERE confidence >= 0.1) WHERE rank <= 10"""


@query(f"""WITH {values('technique', 'technique_keyword')}, {_CORPUS}, {_POST},
i AS (SELECT term, ln((n_rows + 1)::DOUBLE / df) AS idf FROM df, n),
base AS (SELECT doc_id, sum(qtf * idf) AS base FROM q JOIN i USING (term) GROUP BY doc_id),
part AS (SELECT doc_id, row_id, sum(qtf * idf * {_WEIGHT}) AS part FROM q JOIN i USING (term) JOIN post USING (term), n GROUP BY doc_id, row_id),
s AS (SELECT base.doc_id, corpus.row_id AS technique_id, base + coalesce(part, 0) AS raw FROM base CROSS JOIN corpus LEFT JOIN part ON part.doc_id = base.doc_id AND part.row_id = corpus.row_id),
{_RANKED}""")
def bm25_v1_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(scorers.bm25_v1(docs_of(spark, sf_dir), corpus(spark)))


@query(f"""WITH {values('technique', 'technique_keyword')}, {_CORPUS}, {_POST},
j AS (SELECT term, ln(n_rows - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM df, n),
i AS (SELECT term, CASE WHEN i < 0 THEN 0.25::DOUBLE * avg(i) OVER () ELSE i END AS idf FROM j),
s AS (SELECT doc_id, row_id AS technique_id, sum(qtf * idf * {_WEIGHT}) AS raw FROM q JOIN i USING (term) JOIN post USING (term), n GROUP BY doc_id, row_id),
{_RANKED}""")
def bm25_v1_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(scorers.bm25_v1(docs_of(spark, sf_dir), corpus(spark), "okapi"))


_FIELDS = """corpus AS (SELECT technique_id || '|' || field || '|' || body AS row_id, technique_id, field, weight, body FROM (
    SELECT technique_id, 'name' AS field, 3.0::DOUBLE AS weight, name AS body FROM technique
    UNION ALL SELECT technique_id, 'description', 1.5::DOUBLE, string_split(description, '.')[1] || '.' || string_split(description, '.')[2] FROM technique
    UNION ALL SELECT technique_id, 'keyword', 2.0::DOUBLE, keyword FROM technique_keyword))"""
_BEST = """, t AS (SELECT doc_id, technique_id, field, raw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, technique_id ORDER BY raw DESC, row_id) AS b FROM s) WHERE b = 1),
c AS (SELECT *, round(raw / mx, 6) AS confidence FROM (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS mx FROM t) WHERE mx > 0)
SELECT doc_id, technique_id, field, raw, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, technique_id) AS rank FROM c WHERE confidence >= 0.1) WHERE rank <= 10"""


def _ranked_fields(scores: DataFrame) -> DataFrame:
    return scorers.top_k(scorers.normalised(scores), 10).select("doc_id", "technique_id", "field", "raw", "confidence", "rank")


def fields(spark: SparkSession) -> DataFrame:
    t, k = dim(spark, "technique"), dim(spark, "technique_keyword")
    part = lambda d, name, weight, body: d.select("technique_id", F.lit(name).alias("field"), F.lit(weight).alias("weight"), body.alias("body"))
    rows = part(t, "name", 3.0, F.col("name")).unionByName(part(t, "description", 1.5, tx.first_sentences(F.col("description"), 2))).unionByName(part(k, "keyword", 2.0, F.col("keyword")))
    return rows.withColumn("row_id", F.concat_ws("|", "technique_id", "field", "body"))


@query(f"""WITH {values('technique', 'technique_keyword')}, {_FIELDS}, {_POST.replace("'row_id', 'body'", "'row_id', 'lower(body)'").replace("string_split_regex(body", "string_split_regex(lower(body)")},
i AS (SELECT term, ln(1 + (n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, n),
base AS (SELECT doc_id, count(*)::DOUBLE AS base FROM q GROUP BY doc_id),
part AS (SELECT doc_id, row_id, sum(idf * {_WEIGHT}) AS part FROM q JOIN i USING (term) JOIN post USING (term), n GROUP BY doc_id, row_id),
s AS (SELECT base.doc_id, corpus.row_id, technique_id, field, round((base + coalesce(part, 0)) * weight, 6) AS raw FROM base CROSS JOIN corpus LEFT JOIN part ON part.doc_id = base.doc_id AND part.row_id = corpus.row_id)
{_BEST}""")
def bm25_v2_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_fields(scorers.bm25_v2(docs_of(spark, sf_dir), fields(spark)))


@query(f"""WITH {values('technique', 'technique_keyword')}, {_FIELDS}, {_POST.replace("string_split_regex(body", "string_split_regex(lower(body)")},
i AS (SELECT term, ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1e-10::DOUBLE) AS idf FROM df, n),
part AS (SELECT doc_id, row_id, sum(idf * {_WEIGHT}) AS part FROM q JOIN i USING (term) JOIN post USING (term), n GROUP BY doc_id, row_id),
s AS (SELECT doc_id, row_id, technique_id, field, round(part * weight, 6) AS raw FROM part JOIN corpus USING (row_id) WHERE part * weight <> 0)
{_BEST}""")
def bm25_v2_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_fields(scorers.bm25_v2(docs_of(spark, sf_dir), fields(spark), "okapi"))


@query("""WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r]+')) AS term FROM benchmark),
t AS (SELECT item_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), l AS (SELECT item_id, sum(tf) AS dl FROM t GROUP BY item_id)
SELECT term, count(*) AS df, (SELECT count(*) FROM l) AS n_rows, round((SELECT avg(dl) FROM l), 6) AS avgdl FROM t GROUP BY term""")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = scorers.postings(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("body")))
    df, totals = scorers.corpus_stats(post)
    return df.crossJoin(totals).select("term", "df", "n_rows", F.round("avgdl", 6).alias("avgdl"))


_STOP = ", ".join(f"'{w}'" for w in scorers.STOPWORDS)
_SYN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in scorers.SYNONYMS.items()) + "}"
#: \\b knows ASCII letters only in SQL: accented ones are written as letters that occur nowhere else, and back.
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"


def _marked(c: str) -> str:
    """The text with the ids replaced by numbered marks."""
    pieces = f"string_split_regex({c}, '{scorers.PROTECTED}')"
    return f"array_to_string(list_transform({pieces}, lambda p, i: p || CASE WHEN i < len({pieces}) THEN '__PRESERVED_' || (i - 1) || '__' ELSE '' END), '')"


def replaced(c: str, back: bool) -> str:
    for i, a in enumerate(_ACCENTED):
        c = f"replace({c}, 'QZ{i:02d}ZQ', '{a}')" if back else f"replace({c}, '{a}', 'QZ{i:02d}ZQ')"
    return c


@query(f"""WITH l AS MATERIALIZED (SELECT doc_id, {replaced('lower(text)', False)} AS low FROM ({TOLD})),
m AS MATERIALIZED (SELECT doc_id, regexp_extract_all(low, '{scorers.PROTECTED}') AS kept, {_marked('low')} AS marked FROM l),
w AS MATERIALIZED (SELECT doc_id, kept, list_filter(regexp_extract_all({replaced('marked', True)}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})) AS ws FROM m),
f AS MATERIALIZED (SELECT doc_id, kept, list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '__PRESERVED_[0-9]+__') THEN kept[CAST(regexp_extract(w, '[0-9]+') AS INTEGER) + 1] ELSE coalesce({_SYN}[w], w) END) AS found FROM w),
t AS (SELECT doc_id, list_concat(found, list_filter(kept, lambda v, i: NOT list_contains(found, v) AND list_position(kept, v) = i)) AS tokens FROM f)
SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, md5(array_to_string(tokens, ' ')) AS digest FROM t""")
def tokenize_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = told(spark, sf_dir).select("doc_id", scorers.security_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


_CVES = "SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)CVE-[0-9]{4}-[0-9]{1,7}'), lambda x: upper(x)))) AS cve_id FROM d"


@query(f"""WITH {values('cve_technique')}, d AS ({TOLD}), m AS ({_CVES})
SELECT doc_id, technique_id, max(confidence) AS confidence, min(cve_id) AS cve_id, string_agg(DISTINCT cve_id, ',' ORDER BY cve_id) AS cve_ids FROM m JOIN cve_technique USING (cve_id) WHERE confidence >= 0.5 GROUP BY doc_id, technique_id""")
def kev_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.kev(told(spark, sf_dir), dim(spark, "cve_technique")).withColumn("cve_ids", F.array_join("cve_ids", ","))


@query(f"""WITH {derived_sql('cve_technique', 'cve_cwe', 'cwe_technique')}, c AS (SELECT DISTINCT cve_id FROM cve_cwe)
SELECT DISTINCT cve_id, technique_id, confidence, 'direct' AS source FROM c JOIN cve_technique USING (cve_id)
UNION ALL SELECT c.cve_id, w.technique_id, 0.6::DOUBLE, 'cwe_derived:' || x.cwe_id FROM c JOIN cve_cwe x USING (cve_id) JOIN cwe_technique w USING (cwe_id)
WHERE NOT EXISTS (SELECT 1 FROM cve_technique t WHERE t.cve_id = c.cve_id AND t.technique_id = w.technique_id)""")
def kev_with_cwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cwe, direct = derived(spark, sf_dir, "cve_cwe"), derived(spark, sf_dir, "cve_technique", repeats=True)
    return scorers.cve_to_techniques(cwe.select("cve_id").distinct(), direct, cwe, derived(spark, sf_dir, "cwe_technique"), parts_for(spark, direct.count(), DEALT_ROWS))


@query(f"""WITH {derived_sql('cve_technique', 'cve_cwe')}
SELECT cwe_id, technique_id, count(DISTINCT cve_id) AS cve_count, 0.7::DOUBLE AS confidence FROM cve_cwe JOIN cve_technique USING (cve_id) GROUP BY cwe_id, technique_id""")
def cwe_to_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = derived(spark, sf_dir, "cve_technique", repeats=True)
    return scorers.cwe_to_techniques(derived(spark, sf_dir, "cve_cwe"), direct, parts_for(spark, direct.count(), DEALT_ROWS))


@query(f"""WITH {derived_sql('technique', 'cwe_technique', 'cwe_rule')}
SELECT cwe_id, technique_id FROM cwe_technique UNION SELECT cwe_id, technique_id FROM technique JOIN cwe_rule ON contains(lower(description), word_a) AND contains(lower(description), word_b)""")
def cwe_map_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.cwe_map(derived(spark, sf_dir, "technique"), derived(spark, sf_dir, "cwe_technique"), derived(spark, sf_dir, "cwe_rule"))


@query(f"""WITH {values('cve_technique')}, d AS ({TOLD}), m AS ({_CVES.replace('list_distinct(', '(')})
SELECT doc_id, technique_id, cve_id, confidence, count(*) AS mentions FROM m JOIN cve_technique USING (cve_id) GROUP BY ALL""")
def techniques_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cves = told(spark, sf_dir).select("doc_id", F.explode(tx.mentions(F.col("text"), "cve")).alias("cve_id"))
    return cves.join(dim(spark, "cve_technique"), "cve_id").groupBy("doc_id", "technique_id", "cve_id", "confidence").agg(F.count(F.lit(1)).alias("mentions"))


def _vectors(metric: str, where: str = "") -> str:
    dot = "list_dot_product(a.e, b.e)"
    score = f"CASE WHEN a.n > 0 AND b.n > 0 THEN {dot} / (a.n * b.n) ELSE 0 END" if metric == "cosine" else f"1 / (1 + greatest(a.n * a.n + b.n * b.n - 2 * {dot}, 0))"
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({score}, 12) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
    SELECT query_id, vec_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s{where}) WHERE rank <= 5"""


@query(_vectors("cosine"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return scorers.vector_topk(e.where("vec_id % 50 = 0"), e, 5)


@query(_vectors("cosine", " WHERE score >= 0.5"))
def semantic_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that the semantic scorer takes: from the threshold on, before scores are rounded."""
    e = table(spark, sf_dir, "embeddings")
    return scorers.vector_topk(e.where("vec_id % 50 = 0"), e, 5, threshold=0.5)


def _segments(metric: str, least: float) -> str:
    dot = "list_dot_product(a.e, b.e)"
    score = f"{dot} / (a.n * b.n)" if metric == "cosine" else f"1 / (1 + greatest(a.n * a.n + b.n * b.n - 2 * {dot}, 0))"
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT CAST(floor(a.vec_id / 5) AS BIGINT) AS doc_id, a.vec_id AS seg, b.vec_id AS technique_id, round({score}, 12) AS s FROM e a, e b WHERE b.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY s DESC, technique_id) AS r FROM s), m AS (SELECT doc_id, technique_id, max(s) AS s, count(*) FILTER (r <= 4) AS n_segments FROM k GROUP BY ALL)
SELECT doc_id, technique_id, round(s, 4) AS confidence, n_segments, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, technique_id) AS rank FROM m WHERE s >= {least}) WHERE rank <= 4"""


@query(_segments("cosine", 0.2))
def semantic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five segments each against techniques: a technique scores as its nearest segment does."""
    e = table(spark, sf_dir, "embeddings")
    return scorers.by_segments(e.withColumn("doc_id", F.floor(F.col("vec_id") / 5)), e.where("vec_id % 20 = 0"), k=4, threshold=0.2)


@query(_segments("l2", 0.35))
def semantic_segments_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return scorers.by_segments(e.withColumn("doc_id", F.floor(F.col("vec_id") / 5)), e.where("vec_id % 20 = 0"), k=4, threshold=0.35, metric="l2")


@query(_vectors("l2"))
def l2_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists, all of them probed, so that the answer is exact; tests measure recall with fewer probes."""
    e = table(spark, sf_dir, "embeddings")
    return scorers.vector_lists(e.where("vec_id % 50 = 0"), e, 5, lists=16, probes=16)


@query(_vectors("l2"))
def l2_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return scorers.vector_topk(e.where("vec_id % 50 = 0"), e, 5, "l2")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM e),
c AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), v AS (SELECT label AS centre, list(x ORDER BY i) AS c FROM c GROUP BY label),
s AS (SELECT label, centre, list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))) AS s FROM e, v)
SELECT label, centre, count(*) AS n, round(max(s), 4) AS best FROM s GROUP BY label, centre""")
def cosine_max_over_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity of each label's vectors (segments) to each label's mean (a technique): labels are a dimension."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).select(F.col("label").alias("centre"), "c")
    return scorers.vector_group_best(e.select("vec_id", F.col("label").alias("grp"), "embedding"), centres.select(F.col("centre").cast("long").alias("vec_id"), F.col("c").alias("embedding"))).select(F.col("grp").alias("label"), F.col("query_id").cast("int").alias("centre"), "n", F.round("best", 4).alias("best"))


_PAIRS = "pair(entity, keyword, technique_id) AS (VALUES " + ", ".join(f"('{e}', '{k}', '{t}')" for e, k, t in scorers.entity_pairs(dims.ENTITY_TERM, dims.KEYWORD)) + ")"
_NER = f"WITH {values('entity_term', 'affinity')}, {_PAIRS}, m AS (SELECT doc_id, entity, entity_type FROM documents JOIN entity_term ON contains(lower(text), entity)), h AS (SELECT * FROM m JOIN pair USING (entity))"


@query(_NER + """ SELECT doc_id, technique_id, count(DISTINCT entity) AS n_entities, count(DISTINCT (entity, keyword)) AS match_count, round(least(0.4::DOUBLE + 0.05::DOUBLE * count(DISTINCT entity), 0.85::DOUBLE), 6) AS confidence FROM h GROUP BY doc_id, technique_id""")
def entity_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(scorers.entity_pairs(dims.ENTITY_TERM, dims.KEYWORD), "entity string, keyword string, technique_id string")
    return scorers.ner_match(scorers.entity_mentions(docs_of(spark, sf_dir), dims.ENTITY_TERM), pairs)


@query(_NER + """, a AS (SELECT doc_id, technique_id, count(DISTINCT entity) AS n_entities, count(DISTINCT (entity, keyword)) AS match_count FROM h GROUP BY ALL),
b AS (SELECT doc_id, h.technique_id, max(CASE WHEN x.technique_id IS NOT NULL THEN 1.2::DOUBLE WHEN y.p IS NOT NULL THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS boost FROM h
  LEFT JOIN affinity x ON x.entity_type = h.entity_type AND x.technique_id = h.technique_id
  LEFT JOIN (SELECT DISTINCT entity_type, split_part(technique_id, '.', 1) AS p FROM affinity WHERE contains(technique_id, '.')) y ON y.entity_type = h.entity_type AND starts_with(h.technique_id, y.p) GROUP BY ALL)
SELECT doc_id, technique_id, n_entities, match_count, boost, round(least((0.3::DOUBLE + 0.5::DOUBLE * least(0.4::DOUBLE + 0.05::DOUBLE * n_entities, 0.75::DOUBLE)) * boost, 0.9::DOUBLE), 6) AS confidence FROM a JOIN b USING (doc_id, technique_id)""")
def ner_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(scorers.entity_pairs(dims.ENTITY_TERM, dims.KEYWORD), "entity string, keyword string, technique_id string")
    return scorers.ner_match(scorers.entity_mentions(docs_of(spark, sf_dir), dims.ENTITY_TERM), pairs, dim(spark, "affinity"))


@query("SELECT doc_id, count(*) AS n_entities, string_agg(entity_type || ':' || n, ',' ORDER BY entity_type) AS counts FROM (SELECT doc_id, entity_type, count(*) AS n FROM (" + f"WITH {values('entity_term')} SELECT doc_id, entity_type FROM documents JOIN entity_term ON contains(lower(text), entity)" + ") GROUP BY ALL) GROUP BY doc_id")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scorers.entity_mentions(docs_of(spark, sf_dir), dims.ENTITY_TERM).groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat("entity_type", F.lit(":"), "n")))
    return by.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"), F.array_join(pairs, ",").alias("counts"))


#: Line items stand for candidates: an order is a document, discounts are confidences.
_IDS = [t[0] for t in dims.TECHNIQUE]
_NAMES = ["rule_based", "bm25", "ner", "semantic", "kev", "other"]
_PRODUCTION = ["enhanced_rule_based", "enhanced_bm25", "optimized_ner", "optimized_semantic", "kev", "classifier"]


def _candidates_sql(names: list[str]) -> str:
    ids, ns = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (_IDS, names))
    return f"c AS (SELECT l_orderkey AS doc_id, ({ids})[l_partkey % 6 + 1] AS technique_id, ({ns})[l_linenumber % 6 + 1] AS extractor, l_discount * 10 AS confidence, l_returnflag = 'R' AS has_cve, CAST(l_quantity AS INTEGER) % 7 AS n_keywords FROM lineitem)"


def candidates(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), pick(_IDS, F.col("l_partkey") % 6).alias("technique_id"), pick(names, F.col("l_linenumber") % 6).alias("extractor"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").alias("has_cve"), (F.col("l_quantity").cast("int") % 7).alias("n_keywords"),
    )
    return dealt(rows, "doc_id")


@query(f"""WITH {values('combine_weight')}, {_candidates_sql(_NAMES)},
w AS (SELECT c.*, confidence * coalesce(weight, 0.6::DOUBLE) AS wc FROM c LEFT JOIN combine_weight USING (extractor)),
x AS (SELECT *, least(wc * CASE WHEN has_cve THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n_keywords > 3 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE) AS lone FROM w WHERE wc >= 0.2)
SELECT doc_id, technique_id, string_agg(DISTINCT extractor, '+' ORDER BY extractor) AS method,
round(CASE WHEN count(DISTINCT extractor) >= 2 THEN least(avg(wc) * (1 + 0.1::DOUBLE * least(count(DISTINCT extractor), 3)), 1.0::DOUBLE) ELSE max(lone) END, 6) AS confidence FROM x GROUP BY doc_id, technique_id""")
def combine_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combine_weighted(candidates(spark, sf_dir, _NAMES), dict(dims.COMBINE_WEIGHT))


@query(f"""WITH {_candidates_sql(_NAMES)}, w(extractor, w) AS (VALUES ('rule_based', 0.25::DOUBLE), ('bm25', 0.2::DOUBLE), ('ner', 0.2::DOUBLE), ('kev', 0.25::DOUBLE), ('semantic', 0.1::DOUBLE)),
m AS (SELECT doc_id, technique_id, extractor, max(confidence) AS c, coalesce(any_value(w), 0) AS w FROM c LEFT JOIN w USING (extractor) GROUP BY ALL),
s AS (SELECT doc_id, technique_id, sum(c * w) AS s, count(*) FILTER (w > 0) AS n, bool_or(extractor = 'kev' AND c > 0) AS k FROM m GROUP BY ALL)
SELECT doc_id, technique_id, n AS n_extractors, round(least(s * CASE WHEN n > 1 THEN 1 + 0.1::DOUBLE * n ELSE 1 END * CASE WHEN k THEN 1.1::DOUBLE ELSE 1 END, 1::DOUBLE), 6) AS confidence FROM s""")
def fixed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fixed_ensemble(candidates(spark, sf_dir, _NAMES))


def _advanced_sql(names: list[str], related: bool) -> str:
    overlap = "coalesce(o.overlap, 0)" if related else "0"
    more = """p AS (SELECT DISTINCT src AS a, dst AS b FROM edge WHERE src LIKE 'T%' AND dst LIKE 'T%' AND src <> dst UNION SELECT DISTINCT dst, src FROM edge WHERE src LIKE 'T%' AND dst LIKE 'T%' AND src <> dst),
    o AS (SELECT b.doc_id, b.technique_id, count(DISTINCT x.technique_id) AS overlap FROM b JOIN p ON p.a = b.technique_id JOIN b x ON x.doc_id = b.doc_id AND x.technique_id = p.b GROUP BY ALL),""" if related else ""
    join = "LEFT JOIN o ON o.doc_id = b.doc_id AND o.technique_id = b.technique_id" if related else ""
    return f"""WITH {values('ensemble', 'edge')}, {_candidates_sql(names)},
    m AS (SELECT doc_id, technique_id, extractor, max(confidence) AS c FROM c GROUP BY ALL),
    a AS (SELECT doc_id, technique_id, sum(greatest(0, least(1, c * scale + shift)) * weight) / sum(weight) AS m, count(*) AS n FROM m JOIN ensemble USING (extractor) GROUP BY ALL),
    b AS (SELECT *, CASE WHEN n > 1 THEN least(m * (1 + 0.1::DOUBLE * least(n - 1, 3)), 0.98::DOUBLE) ELSE m END AS s FROM a), {more}
    f AS (SELECT b.doc_id, b.technique_id, n, {overlap} AS overlap, round(CASE WHEN n >= 2 AND {overlap} > 0 THEN least(s * (1 + 0.05::DOUBLE * least({overlap}, 3)), 0.98::DOUBLE) ELSE s END, 9) AS confidence FROM b {join})
    SELECT doc_id, technique_id, n, CAST(overlap AS BIGINT) AS overlap, confidence FROM f WHERE confidence >= 0.2"""


@query(_advanced_sql(_NAMES, False))
def advanced_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.advanced_ensemble(candidates(spark, sf_dir, _NAMES), dim(spark, "ensemble"))


@query(_advanced_sql(_PRODUCTION, True))
def ensemble_related_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnwatch.operators.graph import undirected

    edges = dim(spark, "edge").where("src LIKE 'T%' AND dst LIKE 'T%'")
    related = undirected(edges).where("a <> b").select("a", "b").distinct()
    return fusion.advanced_ensemble(candidates(spark, sf_dir, _PRODUCTION), dim(spark, "ensemble"), related)


@query(f"""WITH {_candidates_sql(_NAMES)}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, technique_id ORDER BY confidence DESC, extractor) AS f FROM c)
SELECT doc_id, technique_id, extractor, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, technique_id) AS rank FROM f WHERE f = 1) WHERE rank <= 3""")
def dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedupe_max(candidates(spark, sf_dir, _NAMES), 3)


def _density(patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(w, '(?i)\\b(?:{p})\\b'))" for p in patterns) + ")::DOUBLE / greatest(word_count, 1)"


_COMPLEX = f"""x AS (SELECT doc_id, {ascii_words('text')} AS w, length(text) AS char_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word_count,
    len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '[ \\t\\n\\r]+', '', 'g') <> '')) AS sentence_count FROM ({TOLD})),
y AS (SELECT *, CASE WHEN sentence_count > 0 THEN word_count::DOUBLE / sentence_count ELSE 0 END AS avg_sentence_length, {_density(fusion.TECHNICAL)} AS t, {_density(fusion.SECURITY)} AS s FROM x),
z AS (SELECT doc_id, char_count, word_count, sentence_count, round(avg_sentence_length, 6) AS avg_sentence_length, round(t, 6) AS technical_density, round(s, 6) AS security_term_density,
    round(least(1, 0.3::DOUBLE * least(1, t * 10) + 0.7::DOUBLE * least(1, s * 5)), 6) AS technical_score FROM y)"""


@query(f"WITH {_COMPLEX} SELECT * FROM z")
def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.text_complexity(told(spark, sf_dir))


@query(f"""WITH {values('ensemble')}, {_COMPLEX}, w AS (SELECT doc_id, extractor, weight * CASE extractor
  WHEN 'enhanced_rule_based' THEN CASE WHEN technical_score > 0.7 THEN 0.9::DOUBLE WHEN technical_score < 0.3 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN word_count > 1000 THEN 0.9::DOUBLE WHEN word_count < 100 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN avg_sentence_length > 25 THEN 0.9::DOUBLE ELSE 1 END
  WHEN 'enhanced_bm25' THEN CASE WHEN technical_score > 0.7 THEN 1.2::DOUBLE WHEN technical_score < 0.3 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN word_count < 100 THEN 1.1::DOUBLE ELSE 1 END
  WHEN 'optimized_ner' THEN CASE WHEN technical_score > 0.7 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN avg_sentence_length > 25 THEN 1.1::DOUBLE ELSE 1 END
  WHEN 'optimized_semantic' THEN CASE WHEN technical_score < 0.3 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN word_count > 1000 THEN 1.2::DOUBLE WHEN word_count < 100 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN avg_sentence_length > 25 THEN 1.1::DOUBLE ELSE 1 END
  ELSE 1 END AS w FROM z CROSS JOIN ensemble)
SELECT doc_id, extractor, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS weight FROM w""")
def adapt_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.adapt_weights(fusion.text_complexity(told(spark, sf_dir)), {e: w for e, w, _, _ in dims.ENSEMBLE})


_FEEDBACK = [
    "CASE WHEN doc_id % 3 = 0 THEN 'kev' WHEN doc_id % 3 = 1 THEN 'bm25' ELSE 'ner' END AS extractor",
    "CASE WHEN quality = 1 AND doc_id % 5 <> 0 THEN 'correct' WHEN toxic = 1 THEN 'unsure' ELSE 'incorrect' END AS kind",
    "CASE WHEN doc_id % 4 <> 1 THEN 'T1059' END AS suggested", "doc_id AS seq",
]


@query(f"""WITH RECURSIVE f AS (SELECT {', '.join(_FEEDBACK)} FROM labels),
o AS (SELECT *, row_number() OVER (PARTITION BY extractor ORDER BY seq) AS i FROM f WHERE kind = 'correct' OR (kind = 'incorrect' AND suggested IS NOT NULL)),
r AS (SELECT extractor, 0::BIGINT AS i, 1.0::DOUBLE AS w FROM (SELECT DISTINCT extractor FROM o)
  UNION ALL SELECT r.extractor, o.i, CASE WHEN o.kind = 'correct' THEN least(w * 1.05::DOUBLE, 1.5::DOUBLE) ELSE greatest(w * 0.95::DOUBLE, 0.5::DOUBLE) END FROM r JOIN o ON o.extractor = r.extractor AND o.i = r.i + 1)
SELECT extractor, max(i) AS n, round(arg_max(w, i), 6) AS weight FROM r GROUP BY extractor""")
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.feedback_weights(table(spark, sf_dir, "labels").selectExpr(*_FEEDBACK))


_CHUNKED = """k AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) > 25000 THEN greatest(length(text) - 500, 1) ELSE 1 END, 4500)) AS s, text FROM documents),
d AS (SELECT doc_id, s // 4500 AS chunk_id, substr(text, s + 1, CASE WHEN length(text) > 25000 THEN 5000 ELSE length(text) END) AS text FROM k)"""


@query(f"""WITH {_CHUNKED}, {_v1('doc_id, chunk_id')}, o AS ({_V1_OUT.replace('SELECT doc_id', 'SELECT doc_id, chunk_id', 1)}), e AS (SELECT doc_id, chunk_id, technique_id, unnest(string_split(keywords, ',')) AS keyword, confidence FROM o)
SELECT doc_id, technique_id, max(confidence) AS confidence, count(DISTINCT chunk_id) AS n_chunks, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM e GROUP BY doc_id, technique_id""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = docs_of(spark, sf_dir).select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c"))
    keyed = chunked.select("doc_id", F.col("c.chunk_id").alias("chunk_id"), F.col("c.text").alias("text"))
    return fusion.chunk_merge(scorers.rule_v1(keyed, dims.KEYWORD, keys=("doc_id", "chunk_id")))
