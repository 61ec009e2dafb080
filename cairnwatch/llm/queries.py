"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwatch.llm import decontaminate, linededup, minhash, mixing, negatives, oddsketch, packing, periodic, secrets, sharding, simhash, toxicity, warc
from cairnwatch.llm.common import shared_path, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizers(spark: SparkSession) -> str:
    """The folder of the public tokenizers' files, the same on every executor: spark.cairnwatch.tokenizers."""
    return spark.conf.get("spark.cairnwatch.tokenizers", packing.TOKENIZERS)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; null and empty texts have none, repeated rows each give a row."""
    return secrets.scan(table(spark, sf_dir, "documents"), vocabulary=f"{tokenizers(spark)}/byte_bpe_50k.tiktoken")


def op2_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form; null texts are empty, and a text without words has the fingerprint ''."""
    return minhash.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by a model learnt outside the held-out fold; null and empty texts score as one empty word."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows as read back from the binary files written for them."""
    return packing.written(table(spark, sf_dir, "documents"), shared_path(spark, "packs"), seq_len=2048, folder=tokenizers(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as records and read back; a null page is an empty payload."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "target_uri")


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in 24 shards of equal counts, equal texts together; a null text is empty."""
    rows = sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and their components within four bits; texts without words have fingerprint zero."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text inside windows of benchmark items; a null text has no words."""
    rows = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row; a null source is one of its own, a null text has size 0."""
    rows = mixing.plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def op10_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of 50 words or more; a null text stays null."""
    return linededup.deduplicate(table(spark, sf_dir, "documents"), min_words=50)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 50; the labels of ids divisible by 7 are moved on by one."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=vec_id % 50 == 0, label=moved, positives=5, negatives=3, low=50, high=95)


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 5-word shingle sets that are 85 % alike; a null id is kept where its whole component has no other."""
    rows = oddsketch.similar_sets(table(spark, sf_dir, "documents"), shingle=5, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """documents in which the words of every tenth text (by the id's checksum) repeat from some word on; a null id changes nothing."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    rows = rows.withColumns({"n": n, "a": F.when(n > 0, a).cast("int"), "p": F.when(n > 0, p).cast("int")})
    at = F.sequence(F.lit(0), F.col("n") - 1)
    changed = F.transform(at, lambda i: F.col("w")[F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))])
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts, a tenth of which are given periodic tails first; the longest run and digests."""
    rows = periodic.periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.s"), -F.col("best.p")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_one_permutation_minhash": op2_one_permutation_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_token_packing": op4_token_packing,
    "op5_warc": op5_warc,
    "op6_label_propagation": op6_label_propagation,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_entropy_balancing": op9_entropy_balancing,
    "op10_line_suffix_array": op10_line_suffix_array,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_odd_sketches": op12_odd_sketches,
    "op13_periodic_runs": op13_periodic_runs,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
        WITH d AS ({_words_sql('documents', 'doc_id')}),
             i AS ({_words_sql('benchmark', 'item_id')}),
             s AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
             iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
             dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
             h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win),
             p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
             q AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
    """,
    "op10_line_suffix_array": """
        WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
             a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
             l AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM a),
             x AS (SELECT doc_id, line, pos, w, row_number() OVER o AS idx, sum(w) OVER o AS c FROM l WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
             y AS (SELECT *, c - w AS a, c - 50 AS need, c - w + 50 AS upto FROM x),
             win AS (SELECT y.doc_id, y.idx AS b, z.idx AS e FROM y ASOF JOIN x z ON y.doc_id = z.doc_id AND y.upto <= z.c
                     UNION SELECT y.doc_id, z.idx, y.idx FROM y ASOF JOIN y z ON y.doc_id = z.doc_id AND y.need >= z.a),
             k AS (SELECT win.doc_id, b, e, md5(string_agg(md5(line), '' ORDER BY idx)) AS content FROM win JOIN x ON x.doc_id = win.doc_id AND x.idx BETWEEN b AND e GROUP BY ALL),
             f AS (SELECT content, min((doc_id, b)) AS first FROM k GROUP BY content),
             g AS (SELECT doc_id, CASE WHEN first[1] = doc_id THEN greatest(b, first[2] + e - b + 1) ELSE b END AS b, e FROM k JOIN f USING (content) WHERE first <> (doc_id, b)),
             gone AS (SELECT DISTINCT x.doc_id, x.pos FROM g JOIN x ON x.doc_id = g.doc_id AND x.idx BETWEEN g.b AND g.e),
             kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM a ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT t.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(len(ls) - coalesce(n, 0), 0) AS n_deleted, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
        FROM t LEFT JOIN kept USING (doc_id)
    """,
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER r AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW r AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER r <= 3
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
             g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to, url AS target_uri
        FROM p LEFT JOIN g ON g.h = p.h AND p.n >= 1000
    """,
}
