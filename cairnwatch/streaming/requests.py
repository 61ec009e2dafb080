"""Structured Streaming forms of the request limits and of job states, equal to the batch forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, ts_us long, event_id long, event_type string"
LATEST = "user_id long, event_type string, event_id long, n_events long"


def rate_windows(events: DataFrame, window: str, limit: int, late: str = "1 hour") -> DataFrame:
    """(user_id, window, n, rejected) in tumbling windows; state is dropped once the watermark passes a window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.groupBy("user_id", F.window("ts", window).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def _advance(key: tuple, batches, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    n, ts, event_id, kind = state.get if state.exists else (0, -(1 << 62), -1, "")
    for pdf in batches:
        n += len(pdf)
        last = pdf.sort_values(["ts_us", "event_id"]).iloc[-1]
        if (int(last.ts_us), int(last.event_id)) > (ts, event_id):
            ts, event_id, kind = int(last.ts_us), int(last.event_id), last.event_type
    state.update((n, ts, event_id, kind))
    # A state lives for a day after its last event, in event time.
    state.setTimeoutTimestamp(max(ts // 1000, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
    yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "event_id": [event_id], "n_events": [n]})


def latest_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The last event of each user as it changes; a state lives for a day after its last event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("ts_us"))
    return rows.groupBy("user_id").applyInPandasWithState(_advance, LATEST, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def expire(entries: DataFrame, ttl: str) -> DataFrame:
    """Entries (key, ts) not older than ttl behind the newest seen, each key once: state goes with the watermark."""
    return entries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])
