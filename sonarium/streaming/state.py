"""Streams that keep state of their own: sessions that close when idle, and what a store of bounded media time holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap_ms: int, delay: str, until_ms: int | None = None) -> DataFrame:
    """(file, opened, closed, events) of each session of a stream (file, from_ms), once the watermark has passed its end.

    A session closes gap_ms after its last event. Events may come late by
    delay. Rows from until_ms on only move the watermark.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("from_ms")).withWatermark("event_time", delay)
    if until_ms is not None:
        timed = timed.where(F.col("event_time") < F.timestamp_millis(F.lit(until_ms)))
    found = timed.groupBy("file", F.session_window("event_time", f"{gap_ms} milliseconds").alias("s")).agg(F.count("*").alias("events"))
    return found.select("file", F.unix_millis("s.start").alias("opened"), F.unix_millis("s.end").alias("closed"), "events")


def recent(intervals: DataFrame, keep_ms: int) -> DataFrame:
    """(file, ord, to_ms) that each file's store holds, told anew whenever rows of the file come; intervals: a stream (file, ord, to_ms).

    The store keeps keep_ms before the newest end by media time and lets go
    of the lowest; rows may come in any order. State is one file's rows of
    keep_ms.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, ords = state.get if state.exists else ([], [])
        rows = pd.DataFrame({"ord": list(ords), "to_ms": list(ends)}, dtype="int64")
        for b in batches:
            rows = pd.concat([rows, b[["ord", "to_ms"]]])
            rows = rows[rows["to_ms"] > rows["to_ms"].max() - keep_ms]
        state.update((rows["to_ms"].tolist(), rows["ord"].tolist()))
        yield rows.assign(file=key[0])[["file", "ord", "to_ms"]]

    file = intervals.schema["file"].dataType.simpleString()
    return intervals.groupBy("file").applyInPandasWithState(step, f"file {file}, ord long, to_ms long", "ends array<long>, ords array<long>", "update", GroupStateTimeout.NoTimeout)
