"""Keyed tables kept in step by a log of changes: hash-bucketed snapshots, tombstones, compaction.

A table lies below one folder: `data/v<n>/bucket=<b>` holds the rows of a key's bucket as of
some version, `manifest/v=<n>` says which folder each bucket is in and which batches of changes
are in there already, `log/batch_id=<id>` holds batches that are not. A batch is appended as it
comes; readers fold the log into the buckets; compaction does so for good and writes only the
buckets that the log touches. A batch or compaction that is run again leaves the same table.
One writer at a time; manifests are written last, so that readers never see half a version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a change does.
INSERT, UPDATE, DELETE = "insert", "update", "delete"


def fold(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the changes (key, op, seq, columns of base) made in the order of seq.

    An insert puts a row in place of any before it, an update sets the columns that it gives
    (a null leaves the old value) and does nothing where there is no row, a delete leaves none.
    Of changes of one key with the same seq, updates come last and deletes before inserts;
    changes without key, op or seq do nothing. The work is two partial aggregations by key.
    """
    columns = [c for c in base.columns if c != key]
    rank = F.when(F.col("op") == DELETE, 0).when(F.col("op") == INSERT, 1).otherwise(2)
    given = changes.where(F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("op").isin(INSERT, UPDATE, DELETE))
    made = given.select(key, "op", F.struct(F.lit(1).alias("tier"), F.col("seq").cast("long").alias("seq"), rank.alias("rank")).alias("_at"), *columns)
    held = base.select(key, F.lit(INSERT).alias("op"), F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("seq"), F.lit(1).alias("rank")).alias("_at"), *columns)
    every = held.unionByName(made)
    whole = F.col("op") != UPDATE
    last = every.where(whole).groupBy(key).agg(F.max_by(F.struct("op", "_at"), "_at").alias("_last")).where(F.col("_last.op") == INSERT)
    live = every.join(last, key).where(F.col("_at") >= F.col("_last._at"))

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)

    return live.groupBy(key).agg(*[latest(c) for c in columns]).select(*base.columns)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_manifest(spark: SparkSession, path: str, version: int, rows: list[tuple], batches: list[str], key: str, buckets: int) -> None:
    """A row a bucket (its number is bounded by `buckets`)."""
    schema = "bucket int, folder string, batches array<string>, key string, buckets int"
    spark.createDataFrame([(b, f, batches, key, buckets) for b, f in rows], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str | None], list[str], str, int]:
    """(version, folder of each bucket, batches in there, key, number of buckets) of the last version."""
    rows = spark.read.parquet(f"{path}/manifest")
    last = rows.where(F.col("v") == rows.agg(F.max("v")).first()[0]).collect()
    return last[0]["v"], {r["bucket"]: r["folder"] for r in last}, list(last[0]["batches"]), last[0]["key"], last[0]["buckets"]


def _written(spark: SparkSession, path: str, data: str) -> dict[int, int]:
    """How many rows each bucket of a version's folder has; buckets without any are absent."""
    try:
        rows = spark.read.parquet(f"{path}/{data}")
    except AnalysisException as e:  # nothing was written, as there are no rows
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return {}
        raise
    if "bucket" not in rows.columns:
        return {}
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A new table of rows, one a key."""
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket", bucket(F.col(key), buckets))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v0")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    have = _written(spark, path, "data/v0")
    _write_manifest(spark, path, 0, [(b, f"data/v0/bucket={b}" if b in have else None) for b in range(buckets)], [], key, buckets)


def append(changes: DataFrame, path: str, batch_id: int | str) -> None:
    """Logs a batch of changes (key, op, seq, columns); the same batch again takes its own place."""
    changes.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")


def pending(spark: SparkSession, path: str, done: list[str]) -> DataFrame | None:
    """Logged changes that no version has yet; None if there never were any."""
    try:
        log = spark.read.option("mergeSchema", "true").parquet(f"{path}/log").withColumn("batch_id", F.col("batch_id").cast("string"))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return log.where(~F.col("batch_id").isin(done)) if done else log


def _buckets(spark: SparkSession, path: str, folders: list[str | None]) -> DataFrame:
    """Rows of some buckets; those without rows have no folder."""
    schema = spark.read.parquet(f"{path}/schema").schema
    have = [f"{path}/{f}" for f in folders if f]
    return spark.read.schema(schema).parquet(*have) if have else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of now: its buckets with the log folded in."""
    _, folders, done, key, _ = manifest(spark, path)
    base = _buckets(spark, path, list(folders.values()))
    log = pending(spark, path, done)
    return base if log is None else fold(base, log, key)


def compact(spark: SparkSession, path: str) -> DataFrame:
    """Folds the log into the buckets that it touches and makes that the next version.

    Returns one row (version, touched, buckets, rows_written). Buckets without changes stay in
    the folders they are in.
    """
    version, folders, done, key, buckets = manifest(spark, path)
    log = pending(spark, path, done)
    result = "version int, touched int, buckets int, rows_written long"
    if log is None:
        return spark.createDataFrame([(version, 0, buckets, 0)], result)
    dealt = log.withColumn("bucket", bucket(F.col(key), buckets))
    touched = sorted(r["bucket"] for r in dealt.where(F.col(key).isNotNull()).select("bucket").distinct().collect())  # bounded by buckets
    batches = sorted(r["batch_id"] for r in log.select("batch_id").distinct().collect())
    if not touched:
        return spark.createDataFrame([(version, 0, buckets, 0)], result)
    folded = fold(_buckets(spark, path, [folders[b] for b in touched]), log, key).withColumn("bucket", bucket(F.col(key), buckets))
    data = f"data/v{version + 1}"
    folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{data}")
    counts = _written(spark, path, data)
    after = folders | {b: f"{data}/bucket={b}" if b in counts else None for b in touched}
    _write_manifest(spark, path, version + 1, sorted(after.items()), sorted({*done, *batches}), key, buckets)
    return spark.createDataFrame([(version + 1, len(touched), buckets, sum(counts.values()))], result)
