"""Tables played as streams, and sinks that a replayed batch leaves as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.sources.shared import shared_folder
from cairnwatch.streaming.verdicts import PROVIDER


def staged(rows: DataFrame, order: Column, batches: int, tag: str = "staged", end: DataFrame | None = None) -> str:
    """Writes rows as so many groups of files that a stream reads one after the other; returns the folder.

    order: a number by which rows are cut into batches of equal ranges. end: rows of a last
    batch of their own, such as an event that lets time pass.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, tag)
    bounds = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    at = F.least(F.floor((order - lo) * batches / F.lit(max(hi - lo, 1))), F.lit(batches - 1)).cast("int")
    dealt = rows.withColumn("_batch", at)
    parts = [dealt.where(F.col("_batch") == b).drop("_batch") for b in range(batches)] + ([end] if end is not None else [])
    for part in parts:  # one file each, one after the other, as a stream takes files by their time
        part.repartition(1).write.mode("append").parquet(path)  # rows are read and told apart by many tasks, written by one
    return path


def played(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_out(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is, handing each micro-batch to `write`."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
