"""Per-request verdicts by windows of a stream, and job progress with states and timers of groups of jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store of streams: on disk, so that states need not fit a task's memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "job_id long, state string, n_events long, first_us long, last_us long, expired boolean"
JOBS = "job_id array<long>, state array<string>, n array<long>, first_us array<long>, last_us array<long>, last_event array<long>"


def rate_verdicts(events: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """windows.rate_verdicts of a stream: each request, once its window is over, with its place in it and whether it is let through.

    Requests may come in any order up to `late` behind the newest one; those that come later
    are dropped by the watermark. Rows without a user or time are dropped as well, a null id counts as -1. A window's
    requests are state until it is over, and then go; those of one user and window are sorted in one task.
    """
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # A user's requests of one moment first: there the watermark drops what is late by its own time, not by its window's end.
    moments = rows.groupBy("user_id", "ts").agg(F.collect_list(F.coalesce("event_id", F.lit(-1))).alias("ids"))
    request = F.transform("ids", lambda i: F.struct(F.unix_micros("ts").alias("ts_us"), i.alias("event_id")))
    held = moments.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("window")).agg(F.array_sort(F.flatten(F.collect_list(request))).alias("held"))
    bucket = F.floor(F.unix_timestamp("window.start") / seconds).cast("long")
    each = held.select(F.col("user_id").cast("long").alias("user_id"), bucket.alias("bucket"), F.posexplode("held").alias("at", "request"))
    place = (F.col("at") + 1).cast("long")
    return each.select(F.col("request.event_id").cast("long").alias("event_id"), "user_id", "bucket", place.alias("place"), (place <= limit).alias("allowed"))


#: Groups that jobs are dealt to, each with one state and one timer: a call for each job would cost more than its rows.
GROUPS = 256


def _advance(ttl_ms: int, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """Adds new events to the jobs of a group; a job's state goes a time to live after its last event."""

    def rows(found: dict[int, tuple], expired: bool) -> pd.DataFrame:
        out = pd.DataFrame([(job, state, n, first, last) for job, (state, n, first, last, _) in found.items()], columns=["job_id", "state", "n_events", "first_us", "last_us"])
        return out.assign(expired=expired)

    jobs = {job: tuple(of) for job, *of in zip(*held.get)} if held.exists else {}
    watermark = held.getCurrentWatermarkMs()
    over = {job: of for job, of in jobs.items() if of[3] // 1000 + ttl_ms <= watermark}  # before the new rows: these begin anew
    for job in over:
        del jobs[job]
    if over:
        yield rows(over, True)
    changed = set()
    for pdf in () if held.hasTimedOut else batches:
        by = pdf.sort_values(["user_id", "ts_us", "event_id"]).groupby("user_id", sort=False)
        new = by.agg(state=("event_type", "last"), n=("ts_us", "size"), first=("ts_us", "first"), last=("ts_us", "last"), event=("event_id", "last"))
        for job, state, n, first, last, event in zip(new.index.tolist(), *(new[c].tolist() for c in new)):
            if job in jobs:
                state0, n0, first0, last0, event0 = jobs[job]
                n, first = n + n0, min(first, first0)
                if (last0, event0) >= (last, event):
                    state, last, event = state0, last0, event0
            jobs[job] = (state, n, first, last, event)
            changed.add(job)
    if changed:
        yield rows({job: jobs[job] for job in changed}, False)
    if not jobs:
        held.remove()
        return
    held.update((list(jobs), *map(list, zip(*jobs.values()))))
    held.setTimeoutTimestamp(max(min(of[3] for of in jobs.values()) // 1000 + ttl_ms, watermark + 1))


def job_progress(events: DataFrame, ttl: str = "24 hours", late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(job_id, state, n_events, first_us, last_us, expired): a row each time a job changes, and a last one when its state expires.

    events: (user_id as the job, event_id, event_type, ts). A job that comes back after it has
    expired begins anew. Jobs are dealt to `groups`, each of which holds its jobs' states.
    """
    advance = partial(_advance, int(pd.Timedelta(ttl).total_seconds() * 1000))
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("user_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce("event_type", F.lit("")).alias("event_type"), "ts", F.unix_micros("ts").alias("ts_us"))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(lambda _, batches, held: advance(batches, held), PROGRESS, JOBS, "update", GroupStateTimeout.EventTimeTimeout)
