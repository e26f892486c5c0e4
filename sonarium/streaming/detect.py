"""Streams: landmark windows matched against an index, candidates kept per file, rows of the last writer, each record once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalogue, detect, match
from ..operators.detect import CONFIRM_SCORE

IDLE_MS = 600_000
#: Rows of a stream of blocks.
BLOCK = "file string, block_from long, block_to long, ad long, start long, end long, score long, ord long"


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; the rate limit stands where a full queue would make a producer wait."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def match_each(index: Callable[[], DataFrame], min_score: int, out: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: matches of each batch of query landmarks (q, h, t).

    index is asked for each batch, so new and withdrawn clips count from the
    next batch on. All landmarks of a query come in one batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        out(match.match(df, index(), min_score), number)

    return batch


def candidates(blocks: DataFrame, confirm_score: int = CONFIRM_SCORE, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(file, ad, start, end, score, agree, confirmed) of each file that blocks of a batch touch, all of them told anew; blocks: a stream of BLOCK.

    A file's candidates are folded from its blocks, which its length bounds
    and which are the state, so blocks may come late, twice and in any order.
    A file of which nothing comes for idle_ms of wall time is closed: its
    blocks go from the state. A stream that waits for that never ends by
    itself; one that takes what is there and ends has no idle_ms (None).
    """
    columns = ["block_from", "block_to", "ad", "start", "end", "score", "ord"]
    at = {c: i for i, c in enumerate(columns)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = {tuple(r) for r in held.get[0]} if held.exists else set()
        for b in batches:
            values = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in columns]
            rows.update(zip(*values, strict=True))
        ordered = sorted(rows, key=lambda r: (r[at["block_from"]], r[at["block_to"]], r[at["ord"]], r[at["ad"]] is not None, r))
        held.update(([list(r) for r in ordered],))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        found = detect.fold_candidates([dict(zip(columns, r, strict=True)) for r in ordered], confirm_score)
        if found:
            yield pd.DataFrame(found).assign(file=key[0])[["file", "ad", "start", "end", "score", "agree", "confirmed"]]

    out = "file string, ad long, start long, end long, score long, agree long, confirmed boolean"
    return blocks.groupBy("file").applyInPandasWithState(step, out, "rows array<array<long>>", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The latest row of each key by (ts, seq), whatever order rows come in: a stream in update mode, whose state is one row of each key."""
    return catalogue.latest(log, *by)


def told_each(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what a batch tells anew goes to path/bN, with its number N as batch.

    Only what changed is written, and a batch that runs again after a failure
    writes the same again.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b{number}")

    return batch


def told_last(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """Of all that told_each wrote under path, the rows of the last batch that told of each key."""
    told = spark.read.parquet(f"{path}/*")
    return told.join(told.groupBy(*by).agg(F.max("batch").alias("batch")), [*by, "batch"]).drop("batch")


def unique_records(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each record once, by its hash, while it is younger than delay by time; records: (hash, ts, ...)."""
    timed = records.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["hash"]).drop("event_time")
