"""Registered queries over streams, change logs, step logs, models, dates and abbreviation tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.functions import dates, expansion
from cairnwatch.operators import classifier, scorers, stepwise
from cairnwatch.plans.dims import dim
from cairnwatch.plans.scoring import TOLD, docs_of, replaced, spread, table, told
from cairnwatch.plans.scoring import ORACLE_SQL as SCORING
from cairnwatch.sources import deltas, sinks
from cairnwatch.sources.shared import shared_folder
from cairnwatch.streaming import replay, verdicts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _shuffled(spark: SparkSession, sf_dir: str, batches: int = 4) -> tuple[str, object]:
    """The events as files that a stream reads in turn: up to two hours out of order, the last event long after all others."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(7200))
    return replay.staged(e, arrival, batches, "events", end), e.schema


@query("""WITH x AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bucket, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) AS place FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT *, place <= 2 AS allowed FROM x""")
def rate_verdicts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event let through or rejected in a stream of files out of order: as in the batch form."""
    path, schema = _shuffled(spark, sf_dir)
    out = shared_folder(spark, "verdicts")
    stream = verdicts.rate_verdicts(replay.played(spark, path, schema), 86_400, 2, late="3 hours")
    replay.run_out(stream, sinks.once(out, "verdict"), shared_folder(spark, "verdicts-progress"))
    return sinks.committed(spark, out, "verdict").where("user_id >= 0")


@query("""SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id""")
def job_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream says of each job when its state expires, a week after its last event."""
    path, schema = _shuffled(spark, sf_dir)
    out = shared_folder(spark, "jobs")
    stream = verdicts.job_progress(replay.played(spark, path, schema), ttl="7 days", late="3 hours")
    replay.run_out(stream, sinks.once(out, "job"), shared_folder(spark, "jobs-progress"), "update")
    return sinks.committed(spark, out, "job").where("expired AND job_id >= 0").select("job_id", "state", "n_events", "first_us", "last_us")


_SYNCED = (("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity_type, count(*) AS entity_count, count(DISTINCT {k}) AS entities, 'success' AS status FROM {t}" for t, k in _SYNCED))
def sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables synced by streams that are started twice from the beginning: the second run's batches replace the first's."""
    path, counted = shared_folder(spark, "sync"), None
    for name, key in _SYNCED:
        rows = table(spark, sf_dir, name)
        staged = replay.staged(rows, F.col(key), 3, name)
        for _ in range(2):
            replay.run_out(replay.played(spark, staged, rows.schema), sinks.once(path, name), shared_folder(spark, "sync-progress"))
        one = sinks.committed(spark, path, name).agg(F.lit(name).alias("entity_type"), F.countDistinct(key).alias("entities"))
        counted = one if counted is None else counted.unionByName(one)
    log = sinks.sync_log(spark, path).groupBy("entity_type", "status").agg(F.sum("entity_count").alias("entity_count"))
    return log.join(counted, "entity_type").select("entity_type", "entity_count", "entities", "status")


_CHANGES = [
    "event_id % 2000 AS c_custkey", "CASE event_id % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op", "event_id AS seq",
    "'new ' || CAST(event_id AS STRING) AS c_name", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS c_mktsegment", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS c_acctbal",
]
_KEPT = ["c_name", "c_mktsegment", "c_acctbal"]


@query(f"""WITH ch AS (SELECT {', '.join(_CHANGES)} FROM events), b AS (SELECT c_custkey, 'insert' AS op, -1 AS seq, {', '.join(_KEPT)} FROM customer), every AS (SELECT * FROM b UNION ALL SELECT * FROM ch),
w AS (SELECT c_custkey, arg_max(op, seq) AS op, max(seq) AS since FROM every WHERE op <> 'update' GROUP BY c_custkey),
live AS (SELECT every.* FROM every JOIN w USING (c_custkey) WHERE w.op = 'insert' AND every.seq >= w.since)
SELECT c_custkey, {', '.join(f'arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}' for c in _KEPT)} FROM live GROUP BY c_custkey""")
def delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the events as changes in their order: three logged batches, one of them twice, compacted after the first."""
    path = shared_folder(spark, "delta")
    deltas.create(table(spark, sf_dir, "customer").select("c_custkey", *_KEPT), path, "c_custkey", buckets=16)
    e = table(spark, sf_dir, "events")
    n = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    for batch in range(3):
        changes = e.where(F.floor(F.col("event_id") * 3 / n) == batch).selectExpr(*_CHANGES)
        for _ in range(2 if batch == 1 else 1):
            deltas.append(changes, path, batch)
        if batch == 0:
            deltas.compact(spark, path)
    return deltas.read(spark, path)


def _mentions(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"T\d{4}(?:\.\d{3})?"), 0))).alias("technique_id"))
    return found.withColumn("confidence", F.lit(0.8))


_STEPS = f"""d AS MATERIALIZED ({TOLD}), m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'T[0-9]{{4}}(?:\\.[0-9]{{3}})?')) AS technique_id FROM d), k AS MATERIALIZED ({SCORING['kev_direct']}),
every AS (SELECT doc_id, technique_id, CAST(0.8 AS DOUBLE) AS confidence FROM m UNION ALL SELECT doc_id, technique_id, confidence FROM k), best AS (SELECT doc_id, technique_id, max(confidence) AS confidence FROM every GROUP BY ALL)"""


@query(f"""WITH {_STEPS} SELECT 0 AS step, 'documents' AS name, 'done' AS status, count(*) AS rows, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most FROM d WHERE trim(text) <> ''
UNION ALL SELECT 1, 'mention', 'done', count(*), CASE WHEN count(*) > 0 THEN 0.8 END, CASE WHEN count(*) > 0 THEN 0.8 END FROM m UNION ALL SELECT 2, 'kev', 'done', count(*), min(confidence), max(confidence) FROM k
UNION ALL SELECT 3, 'semantic', 'failed', 0, NULL, NULL UNION ALL SELECT 4, 'combined', 'done', count(*), min(confidence), max(confidence) FROM best""")
def extraction_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step log of an extraction with one extractor that fails; without its times and errors."""

    def broken(docs: DataFrame) -> DataFrame:
        raise RuntimeError("no model")

    extractors = {"mention": _mentions, "kev": lambda d: scorers.kev(d, dim(spark, "cve_technique")), "semantic": broken}
    _, _, log = stepwise.extract(told(spark, sf_dir), extractors, lambda c: c.groupBy("doc_id", "technique_id").agg(F.max("confidence").alias("confidence")))
    return log.select("step", "name", "status", "rows", "least", "most")


@query(f"""WITH {_STEPS} SELECT every.doc_id, every.technique_id, count(*) AS n, max(every.confidence) AS confidence FROM every GROUP BY ALL""")
def extraction_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such an extraction gives, with how many extractors said so."""
    extractors = {"mention": _mentions, "kev": lambda d: scorers.kev(d, dim(spark, "cve_technique"))}
    combine = lambda c: c.groupBy("doc_id", "technique_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    return stepwise.extract(told(spark, sf_dir), extractors, combine)[0]


@query(None)
def classifier_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each fifth document by a forest learnt from the others, saved and loaded; a test holds its accuracy."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label")))
    path = shared_folder(spark, "forest")
    classifier.save(classifier.train_forest(rows.where("doc_id % 5 <> 0"), trees=20, depth=8), path)
    return classifier.classify_texts(classifier.load(spark, path), rows.where("doc_id % 5 = 0"), threshold=0.2, k=3)


def abbreviation_rows(benchmark: DataFrame) -> DataFrame:
    """(pos, abbreviation, expansion): a table of hundreds of entries from the items' words; some expand to the next one, some hold two words."""
    words = benchmark.select(F.explode(F.split(F.lower("text"), "[ \n]+")).alias("w")).where(F.col("w").rlike("^[a-z]{2,5}$")).distinct()
    w = F.col("w")
    following = words.agg(F.array_sort(F.collect_list("w")).alias("ws")).select(F.posexplode("ws").alias("pos", "w"), "ws")  # one row: the items' short words
    after = F.coalesce(F.get("ws", F.col("pos") + 1), F.lit("end"))
    key = F.when(F.col("pos") % 10 == 5, F.concat(w, F.lit(" "), after)).otherwise(w)
    value = F.when(F.col("pos") % 3 == 0, F.concat(after, F.lit(" of "), F.substring(w, 1, 1))).when(F.col("pos") % 3 == 1, F.concat(w, F.lit("-"), w)).otherwise(F.concat(F.lit("the "), F.reverse(w)))
    return following.select("pos", key.alias("abbreviation"), value.alias("expansion"))


_TABLE = """bw AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[ \n]+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{2,5}')), bp AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS pos, coalesce(lead(w) OVER (ORDER BY w), 'end') AS after FROM bw),
bt AS (SELECT list({'k': CASE WHEN pos % 10 = 5 THEN w || ' ' || after ELSE w END, 'v': CASE pos % 3 WHEN 0 THEN after || ' of ' || w[1] WHEN 1 THEN w || '-' || w ELSE 'the ' || reverse(w) END} ORDER BY pos) AS entries FROM bp)"""


@query(f"""WITH {_TABLE}, x AS (SELECT doc_id, {replaced("list_reduce(list_prepend({'k': '', 'v': %s}, entries), lambda a, e: {'k': '', 'v': regexp_replace(a.v, '\\b' || e.k || '\\b', e.v, 'g')}).v" % replaced('lower(text)', False), True)} AS t FROM documents, bt)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x""")
def expand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with hundreds of abbreviations replaced in order; the plan is as large for any table."""
    rows = abbreviation_rows(table(spark, sf_dir, "benchmark")).orderBy("pos").collect()  # a dimension: each task gets it
    t = expansion.expand(F.col("text"), [(r["abbreviation"], r["expansion"]) for r in rows])
    return docs_of(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


#: Forms of a date by order key: how Spark and SQL write them, and what they must be read as.
_FORMS = [
    ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y"), ("dd-MMM-yy", "%d-%b-%y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("M/d/yyyy", "%-m/%-d/%Y"), ("yyyyMMdd", "%Y%m%d"), ("EEE, dd MMM yyyy", "%a, %d %b %Y"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("yyyy.MM.dd", "%Y.%m.%d"), ("MMM-dd-yyyy", "%b-%d-%Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("d MMMM, yyyy 'at' HH:mm", "%-d %B, %Y at %H:%M"), ("MM-dd-yy", "%m-%d-%y"),
]


@query(f"""SELECT o_orderkey, CASE o_orderkey % {len(_FORMS) + 3} {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{s}')" for i, (_, s) in enumerate(_FORMS))} WHEN {len(_FORMS)} THEN 'soon' WHEN {len(_FORMS) + 1} THEN '31 April 2020' ELSE '13/45/2020' END AS given,
CASE WHEN o_orderkey % {len(_FORMS) + 3} < {len(_FORMS)} THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % {len(_FORMS) + 3} = {len(_FORMS) + 2} THEN '2020-13-45' ELSE '' END AS date FROM orders""")
def flexible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in thirteen forms, and texts that are no dates, as ISO text."""
    d = F.col("o_orderdate").cast("timestamp")
    turn = F.col("o_orderkey") % (len(_FORMS) + 3)
    given = F.when(turn == len(_FORMS), "soon").when(turn == len(_FORMS) + 1, "31 April 2020").when(turn == len(_FORMS) + 2, "13/45/2020")
    for i, (form, _) in enumerate(_FORMS):
        given = given.when(turn == i, F.date_format(d, form))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", given.alias("given"))
    return rows.select("o_orderkey", "given", dates.flexible_date(F.col("given")).alias("date"))
