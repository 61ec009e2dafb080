"""Extraction with an ordered log of its steps: rows, techniques' scores and times, observed as the steps run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairnwatch.sources.shared import shared_folder

LOG = "step int, name string, status string, rows long, least double, most double, error string, duration_ms double"


def extract(docs: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], combine: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(combined, by extractor, log) of extractors run one after the other.

    extractors: by name, functions from documents (doc_id, text) to candidates with doc_id,
    technique_id and confidence. Each step's rows are written to the shared folder and read
    back, so that no step runs twice; counts are observed while they are written. A step that
    fails is logged with its error and the others go on, as long as one is left. combine:
    from all candidates, with the column extractor, to the result. Documents without text are
    left out of the extraction, and counted by the first step.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "steps")
    log: list[tuple] = []

    def step(name: str, rows: Callable[[], DataFrame], score: str | None = "confidence") -> DataFrame | None:
        begun, seen = time.perf_counter(), Observation()
        try:
            df = rows()
            low, high = (F.min(score), F.max(score)) if score else (F.lit(None), F.lit(None))
            kept = df.observe(seen, F.count(F.lit(1)).alias("rows"), low.cast("double").alias("least"), high.cast("double").alias("most")) if score else df.observe(seen, F.count(F.lit(1)).alias("rows"))
            path = f"{folder}/step={len(log)}"
            kept.write.mode("overwrite").parquet(path)
            told, out, error = seen.get, spark.read.schema(df.schema).parquet(path), None
        except Exception as e:
            told, out, error = {}, None, str(e).split("\n")[0][:1000]
        took = round((time.perf_counter() - begun) * 1000, 2)
        log.append((len(log), name, "failed" if error else "done", told.get("rows", 0), told.get("least"), told.get("most"), error, took))
        return out

    texts = step("documents", lambda: docs.where(F.trim(F.coalesce("text", F.lit(""))) != ""), None)
    if texts is None:
        raise RuntimeError(f"the documents can't be read: {log[-1][6]}")
    found = None
    for name, run in extractors.items():
        part = step(name, lambda run=run, name=name: run(texts).select("doc_id", "technique_id", F.col("confidence").cast("double").alias("confidence"), F.lit(name).alias("extractor")))
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, technique_id string, confidence double, extractor string")
    combined = step("combined", lambda: combine(found))
    if combined is None:
        raise RuntimeError(f"the candidates can't be combined: {log[-1][6]}")
    return combined, found, spark.createDataFrame(log, LOG)


def benchmarks(log: DataFrame, job_id: str, operation: str = "extract") -> DataFrame:
    """Rows of the metric table of benchmarks from a step log; the documents' rows are the input's size."""
    size = log.where("step = 0").select(F.col("rows").alias("input_size"))
    rows = log.where("step > 0").crossJoin(F.broadcast(size))  # one row
    return rows.select(F.lit(job_id).alias("job_id"), F.col("name").alias("extractor_name"), F.lit(operation).alias("operation_type"), "input_size", F.round("duration_ms").cast("long").alias("execution_time_ms"))
