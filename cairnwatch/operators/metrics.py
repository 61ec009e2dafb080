"""Usage and service metrics: conditional counts, histograms, windows of requests, alerts, job bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts for each bound and +Inf, in one aggregation; a row a label set and bucket."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = df.groupBy(*by).agg(*counts, F.count(value).alias("inf"))
    buckets = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return rows.select(*by, F.explode(buckets).alias("b")).select(*by, F.col("b.le").alias("le"), F.col("b.n").cast("long").alias("n"))


def user_stats(users: DataFrame, jobs: DataFrame, results: DataFrame, bookmarks: DataFrame, fan_out: bool) -> DataFrame:
    """Per user: jobs, finished jobs, results, mean score, bookmarks.

    users (user_id), jobs (job_id, user_id, status), results (job_id, result_id, score),
    bookmarks (user_id, bookmark_id). With fan_out all are joined before they are counted, so
    that counts multiply; otherwise each side is counted first.
    """
    if fan_out:
        rows = users.join(jobs, "user_id", "left").join(results, "job_id", "left").join(bookmarks, "user_id", "left")
        return rows.groupBy("user_id").agg(
            F.count("job_id").alias("n_jobs"), F.count(F.when(F.col("status") == "F", 1)).alias("n_done"), F.countDistinct("result_id").alias("n_results"),
            F.round(F.avg("score"), 6).alias("avg_score"), F.count("bookmark_id").alias("n_bookmarks"))
    r = jobs.join(results, "job_id").groupBy("user_id").agg(F.countDistinct("result_id").alias("n_results"), F.round(F.avg("score"), 7).alias("avg_score"))
    j = jobs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.count(F.when(F.col("status") == "F", 1)).alias("n_done"))
    b = bookmarks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_bookmarks"))
    rows = users.join(j, "user_id", "left").join(r, "user_id", "left").join(b, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("user_id", zero("n_jobs"), zero("n_done"), zero("n_results"), "avg_score", zero("n_bookmarks"))


def share_of_total(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k largest keys by total value with their share of all."""
    rows = df.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("calls"))
    every = rows.agg(F.sum("total").alias("every"))
    top = rows.orderBy(F.col("total").desc(), key).limit(k)
    return top.crossJoin(every).select(key, "calls", F.round("total", 4).alias("total"), F.round(100 * F.col("total") / F.col("every"), 2).alias("share"))


def cache_stats(events: DataFrame, hit: str, bytes_: str, by: str) -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.sum(F.col(hit).cast("int"))
    return events.groupBy(by).agg(hits.cast("long").alias("hits"), (n - hits).cast("long").alias("misses"), F.round(hits / n, 6).alias("hit_rate"), F.sum(F.col(bytes_).cast("long")).alias("bytes"))


def _held(windows: DataFrame, window: str, hold: int) -> DataFrame:
    """Spans (start, last, n_windows, ...) of `hold` consecutive windows or more, of the windows (start, value) that fire (gaps and islands)."""
    over = windows.withColumn("i", (F.unix_timestamp("start") / F.lit(_seconds(window))).cast("long"))
    island = over.withColumn("island", F.col("i") - F.row_number().over(W.orderBy("i")))  # a row a window of time
    spans = island.groupBy("island").agg(F.min("start").alias("start"), F.max("start").alias("last"), F.count(F.lit(1)).alias("n_windows"), F.max("value").alias("worst"))
    return spans.where(F.col("n_windows") >= hold).select("start", "last", "n_windows", F.round("worst", 6).alias("worst"))


def quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, value): the q-quantile of cumulative bucket counts (by, le as a number, n), linear within a bucket.

    In the last, open bucket it is the highest finite bound; without observations null.
    """
    w = W.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rows = rows.withColumn("rank", q * F.max("n").over(W.partitionBy(*by))).where((F.col("n") >= F.col("rank")) & (F.col("n") > 0))
    first = rows.groupBy(*by).agg(F.min(F.struct("le", "low", "below", "n", "rank")).alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * (F.col("b.rank") - F.col("b.below")) / (F.col("b.n") - F.col("b.below"))
    return first.select(*by, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(inside).alias("value"))


def window_quantile(events: DataFrame, value: str, bounds: list[float], window: str, q: float = 0.95) -> DataFrame:
    """(start, value): the q-quantile of each window from its histogram."""
    rows = events.withColumn("start", F.window("ts", window)["start"])
    counts = histogram(rows, value, bounds, ["start"])
    return quantile(counts.select("start", F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double")).alias("le"), "n"), q, ["start"])


def alert_quantile(events: DataFrame, value: str, bounds: list[float], window: str, limit: float, hold: int, q: float = 0.95) -> DataFrame:
    return _held(window_quantile(events, value, bounds, window, q).where(F.col("value") > limit), window, hold)


def alert_backlog(events: DataFrame, window: str, limit: int, hold: int) -> DataFrame:
    """Spans in which more than `limit` jobs wait: events (ts, change) add up; each window has its last number."""
    by = events.groupBy(F.window("ts", window)["start"].alias("start")).agg(F.sum("change").alias("change"))
    waiting = by.withColumn("value", F.sum("change").over(W.orderBy("start")))  # a row a window of time
    return _held(waiting.where(F.col("value") > limit), window, hold)


def alert_ratio(events: DataFrame, bad, window: str, limit: float, hold: int) -> DataFrame:
    """Spans of `hold` consecutive windows or more in which the share of bad events exceeds the limit (gaps and islands)."""
    rows = events.groupBy(F.window("ts", window)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("bad"))
    rows = rows.withColumn("over", F.col("bad") / F.col("n") > limit)
    over = rows.where("over").withColumn("i", (F.unix_timestamp("start") / F.lit(_seconds(window))).cast("long"))
    island = over.withColumn("island", F.col("i") - F.row_number().over(W.orderBy("i")))  # a row a window of time
    spans = island.groupBy("island").agg(F.min("start").alias("start"), F.max("start").alias("last"), F.count(F.lit(1)).alias("n_windows"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    return spans.where(F.col("n_windows") >= hold).select("start", "last", "n_windows", F.round(F.col("bad") / F.col("n"), 6).alias("ratio"))


def _seconds(window: str) -> int:
    n, unit = window.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def job_bundle(jobs: DataFrame, parts: dict[str, DataFrame], key: str = "job_id") -> DataFrame:
    """One row a job with an array of structs for each part (each collected by itself, then joined)."""
    out = jobs
    for name, part in parts.items():
        fields = [c for c in part.columns if c != key]
        out = out.join(part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), key, "left")
    return out


def lru_evict(entries: DataFrame, share: float = 0.25) -> DataFrame:
    """Entries (tier, key, accessed) among the oldest share of their tier, ties by key.

    No tier comes into one task: counts by second tell in which second a tier's cut falls,
    earlier entries go, and only that second's entries are ranked.
    """
    rows = entries.withColumn("_s", F.unix_timestamp(F.col("accessed").cast("timestamp")))
    counts = rows.groupBy("tier", "_s").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("tier").orderBy("_s")  # a row a second
    seconds = counts.withColumn("upto", F.sum("n").over(w)).withColumn("quota", F.floor(F.sum("n").over(W.partitionBy("tier")) * share))
    seconds = seconds.where(F.col("upto") - F.col("n") < F.col("quota")).select("tier", "_s", (F.col("quota") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") <= F.col("quota")).alias("all"))
    kept = rows.join(seconds, ["tier", "_s"])
    last = kept.where(~F.col("all")).withColumn("r", F.row_number().over(W.partitionBy("tier").orderBy("accessed", "key"))).where(F.col("r") <= F.col("left"))
    return kept.where("all").select("tier", "key", "accessed").unionByName(last.select("tier", "key", "accessed"))
