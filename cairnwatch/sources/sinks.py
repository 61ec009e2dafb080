"""Writers: upserted node and edge snapshots, results by day, lineage and training records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnwatch.operators import graph, snapshot


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, version: str) -> DataFrame:
    """Writes the merge of the last snapshot below `path` with new rows as a new version; returns it.

    Versions are named by a number after letters (v9, v10) and the highest is the last;
    folders of other names, such as those of writes under way, don't count.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    before = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"[A-Za-z]*(\d+)", n)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    merged = snapshot.merge(spark.read.parquet(f"{path}/{before[-1][1]}"), new, key) if before else new
    merged.write.parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


def merge_edges(existing: DataFrame, candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Existing edges with the candidates that both ends exist for, each once."""
    return existing.select("src", "type", "dst").unionByName(graph.build_edges(candidates, nodes)).distinct()


def write_results(results: DataFrame, path: str) -> None:
    """Appends results (with `created`) in a folder a day, so that readers prune by day."""
    results.withColumn("day", F.to_date("created")).write.mode("append").partitionBy("day").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Appends lineage or training records as JSON lines."""
    records.write.mode("append").json(path)


def once(path: str, entity: str) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches (rows, batch id) that a replayed batch leaves as it is.

    Each batch has a folder of its own, which it overwrites, and a row in the log beside it
    (entity_type, batch_id, entity_count, status, error_message, synced_at), written last: a
    batch counts once it is logged as a success. A failed one is logged as such and raised.
    """

    def logged(spark: SparkSession, batch_id: int, count: int, status: str, error: str | None) -> None:
        row = spark.createDataFrame([(entity, count, status, error)], "entity_type string, entity_count long, status string, error_message string")
        row.withColumn("synced_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/entity={entity}/batch_id={batch_id}")

    def write(rows: DataFrame, batch_id: int) -> None:
        counted = Observation()
        try:
            rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/entity={entity}/batch_id={batch_id}")
        except Exception as e:
            logged(rows.sparkSession, batch_id, 0, "failed", str(e).split("\n")[0][:1000])
            raise
        logged(rows.sparkSession, batch_id, counted.get["n"], "success", None)

    return write


def sync_log(spark: SparkSession, path: str) -> DataFrame:
    """(entity_type, batch_id, entity_count, status, error_message, synced_at) of the batches written below `path`."""
    return spark.read.parquet(f"{path}/log").select("entity_type", "batch_id", "entity_count", "status", "error_message", "synced_at")


def committed(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The rows of an entity's batches that are logged as a success."""
    done = sync_log(spark, path).where((F.col("entity_type") == entity) & (F.col("status") == "success")).select("batch_id")
    return spark.read.parquet(f"{path}/rows/entity={entity}").join(done, "batch_id", "left_semi").drop("batch_id")


def last_sync(spark: SparkSession, path: str) -> DataFrame:
    """(entity_type, synced_at) of each entity's last success."""
    return sync_log(spark, path).where("status = 'success'").groupBy("entity_type").agg(F.max("synced_at").alias("synced_at"))


#: The metric tables of a job and their columns beside id and job_id.
METRIC_FAMILIES = {
    "analysis_text_segments": "segment_text string, segment_index int, segment_embedding binary",
    "extractor_results": "extractor_name string, raw_input string, raw_output string, execution_time_ms long, parameters string",
    "analysis_entities": "extractor_id string, entity_text string, entity_type string, start_offset long, end_offset long, confidence double",
    "analysis_keywords": "extractor_id string, technique_id string, keyword string, match_position long, match_context string",
    "bm25_scores": "extractor_id string, technique_id string, raw_score double, normalized_score double, matched_terms string",
    "semantic_scores": "extractor_id string, technique_id string, similarity_score double, embedding_dimension int, model_used string",
    "ensemble_details": "technique_id string, ensemble_method string, final_confidence double, component_scores string, weights_used string",
    "model_execution_metrics": "extractor_id string, model_name string, model_version string, device_used string, memory_usage_mb double, batch_size int, quantization_used boolean, execution_time_ms long",
    "ner_extraction_details": "extractor_id string, entity_count int, entity_types string, model_name string, aggregation_strategy string, tokenizer_max_length int",
    "embedding_details": "extractor_id string, text_segment_id string, technique_id string, embedding_type string, embedding_model string, embedding_dimension int, normalization_applied boolean, cache_hit boolean, cosine_similarity double, approximate_search_used boolean",
    "kev_extraction_details": "extractor_id string, cve_id string, cve_mention_position long, cve_mention_context string, kev_entry_date string, technique_mappings string, confidence_scores string",
    "classifier_details": "extractor_id string, model_type string, feature_count int, class_count int, probability_scores string, decision_threshold double, embedding_used boolean",
    "model_weights": "extractor_id string, model_name string, weight_path string, weight_hash string, weight_size_bytes long, quantization_bits int",
    "performance_benchmarks": "extractor_name string, operation_type string, input_size long, execution_time_ms long, throughput_tokens_per_second double, memory_peak_mb double",
}


def metric_rows(family: str, rows: DataFrame) -> DataFrame:
    """(id, job_id, the family's columns) of rows: absent columns are null, further ones are left out.

    Without an id, rows get the digest of what they record, so that a repeated write is told.
    """
    have = {c.lower() for c in rows.columns}
    fields = [f.split(" ") for f in METRIC_FAMILIES[family].split(", ")]
    given = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]
    out = rows.select(F.col("job_id").cast("string").alias("job_id"), *given, *([F.col("id").cast("string").alias("_id")] if "id" in have else []))
    own = F.md5(F.to_json(F.struct(F.lit(family).alias("family"), "job_id", *[n for n, _ in fields])))
    return out.select((F.coalesce("_id", own) if "id" in have else own).alias("id"), "job_id", *[n for n, _ in fields])


def write_metrics(family: str, rows: DataFrame, path: str) -> None:
    """Appends a family's rows to its table below `path`, in a folder a day."""
    metric_rows(family, rows).withColumn("day", F.current_date()).write.mode("append").partitionBy("day").parquet(f"{path}/{family}")
