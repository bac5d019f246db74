"""C18 and C03 as streams: counts by status in event-time windows, and the transition guard as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.ledger import advance


def queue_monitor(events: DataFrame, window: str = "5 minutes", watermark: str = "1 hour") -> DataFrame:
    """events(ts timestamp, status) -> window_start, status, n. Works on streams (append mode) and tables alike."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "status", "n")


def transition_stream(events: DataFrame) -> DataFrame:
    """C03 on a stream of (task_id, seq, requested_status, worker_id): the guard with each task's state kept between batches.

    Events of one task in one batch are taken in order of seq; a later batch is later. Late arrivals are judged when
    they come.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, worker = state.get if state.exists else ("pending", None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            by = None if pd.isna(r.worker_id) else r.worker_id
            ok, status, worker = advance(status, worker, r.requested_status, by)
            out.append((key[0], r.seq, bool(ok), status))
        state.update((status, worker))
        yield pd.DataFrame(out, columns=["task_id", "seq", "accepted", "status"])

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id string, seq long, accepted boolean, status string", "status string, worker string", "append", GroupStateTimeout.NoTimeout)
