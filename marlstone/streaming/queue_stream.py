"""The work queue's fold as stateful streaming: one state per message, moved by its events.

Leases that run out are events here, as the coordinator's reaper sends them;
state has no timers. Late events are folded in the order of their arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def next_state(status: str, attempts: int, move: str, max_attempts: int) -> tuple[str, int]:
    if move == "enqueue" and status in ("none", "done", "failed"):
        return "pending", 0
    if move == "dequeue" and status == "pending":
        return "processing", attempts
    if move == "ack" and status == "processing":
        return "done", attempts
    if move in ("nack", "reap") and status == "processing":
        return ("failed" if attempts + 1 >= max_attempts else "pending"), attempts + 1
    return status, attempts


def fold_stream(events: DataFrame, key: str, order: str, kind: str, moves: dict[str, str], max_attempts: int = 5) -> DataFrame:
    """key, status, attempts after each batch, for keys that had events (update mode)."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("none", 0)
        rows = pd.concat(list(frames)).sort_values("_order")
        for event in rows["_kind"]:
            status, attempts = next_state(status, attempts, moves.get(event, "none"), max_attempts)
        state.update((status, int(attempts)))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "attempts": [int(attempts)]})

    slim = events.select(key, F.col(order).alias("_order"), F.col(kind).alias("_kind"))
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {dict(events.dtypes)[key]}, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by tumbling window of event time and kind, closed once the watermark passes. An extra: the catalog's own stream has no event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return timed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
