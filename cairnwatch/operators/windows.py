"""Time windows and state: request limits, expiry, job states, feedback since the last training, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Requests a minute and an hour, by tier.
LIMITS = {"basic": (30, 500), "premium": (100, 2000), "enterprise": (300, 10_000)}
#: Seconds to live by cache tier.
TTL = {"memory": 300, "shared": 86_400, "file": 604_800}


def rate_window(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(user_id, bucket, n, rejected): requests in tumbling windows; those beyond the limit are rejected but count."""
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds).cast("long")
    rows = events.groupBy("user_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rejected", F.greatest(F.col("n") - limit, F.lit(0)))


def rate_verdicts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Each event with its place in its window and whether it is let through."""
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds).cast("long")
    rows = events.withColumn("bucket", bucket)
    place = F.row_number().over(W.partitionBy("user_id", "bucket").orderBy("ts", "event_id"))
    return rows.select("event_id", "user_id", "bucket", place.cast("long").alias("place"), (place <= limit).alias("allowed"))


def ttl_expired(entries: DataFrame, now: Column, tier: str = "tier") -> DataFrame:
    """Entries whose time to live has passed; those of unknown tier last a day."""
    ttl = F.coalesce(F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])[F.col(tier)], F.lit(86_400))
    return entries.where(F.unix_timestamp(F.col("ts").cast("timestamp")) + ttl < now)


def latest_state(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation (max_by), not a sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return events.groupBy(key).agg(last, F.count(F.lit(1)).alias("n_events")).select(key, "s.*", "n_events")


def since_last(feedback: DataFrame, trainings: DataFrame, least: int) -> DataFrame:
    """Feedback counted after the last training (the epoch if there was none), and whether it suffices."""
    cut = trainings.agg(F.coalesce(F.max("ts"), F.lit("1970-01-01").cast("timestamp")).alias("cut"))
    rows = feedback.crossJoin(cut).where("ts > cut")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= least)


def autoscale(state: DataFrame, lowest: int = 2, highest: int = 10, ratio: int = 2) -> DataFrame:
    """Workers wanted from (queue, jobs, workers): one more above 3 jobs a worker, down to jobs / ratio below 1, within bounds."""
    jobs, workers = F.col("jobs"), F.col("workers")
    load = F.when(workers > 0, jobs / F.greatest(workers, F.lit(1))).otherwise(F.lit(float("inf")))
    share = F.floor(jobs / ratio)
    up = F.least(F.lit(highest), workers + 1, F.greatest(F.lit(lowest), share))
    down = F.greatest(F.lit(lowest), F.least(workers - 1, share + 1))
    want = F.when((load > 3) & (workers < highest), F.greatest(up, workers)).when((load < 1) & (workers > lowest), F.least(down, workers)).otherwise(workers)
    return state.select("queue", "jobs", "workers", want.cast("long").alias("target"))
