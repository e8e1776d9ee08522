"""The batch rules of progress and speech as Structured Streaming: state for each key, event-time windows, upserts by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def progress_totals(events: DataFrame) -> DataFrame:
    """(user_id, event_id, total) as operators.progress.totals gives it, for a stream of (user_id, event_id, bytes) in order within each user: the state is the last value and what is finished."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for id_, now in zip(rows["event_id"], rows["bytes"], strict=True):
            done += last if now < last else 0
            last = int(now)
            out.append((key[0], int(id_), done + last))
        state.update((last, done))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "total"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, total long", "last long, done long", "append", GroupStateTimeout.NoTimeout)


def talk_sessions(events: DataFrame, *, silence: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, opened, closed, n): events of one user with gaps shorter than the silence are one session; later events than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", silence).alias("s"))
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")


def first_of_each(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, event_type): the newest event of each key, for update mode."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.event_type")
