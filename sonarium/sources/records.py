"""Record frames as files of rows of bytes: a writer through Spark's own commit protocol and a reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions import codec

SCHEMA = "kind string, origin binary, seq long, ts long, body binary, sig binary, hash binary"


def encoded(records: DataFrame) -> DataFrame:
    """(id, frame) from (id, kind, origin, seq, ts, body, sig), the bytes columns binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["kind"], b["origin"], b["seq"], b["ts"], b["body"], b["sig"], strict=True)
            yield pd.DataFrame({"id": b["id"], "frame": [codec.frame(codec.Record(k, bytes(o), int(s), int(t), bytes(x), bytes(g))) for k, o, s, t, x, g in rows]})

    return records.mapInPandas(run, "id long, frame binary")


def decoded(frames: DataFrame) -> DataFrame:
    """Records (SCHEMA) from rows with a binary column frame, which may hold several frames; corrupt bytes fail the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.kind, r.origin, r.seq, r.ts, r.body, r.sig, r.digest()) for x in b["frame"] for r in codec.frames(bytes(x))]
            yield pd.DataFrame(rows, columns=["kind", "origin", "seq", "ts", "body", "sig", "hash"])

    return frames.select("frame").mapInPandas(run, SCHEMA)


def write_snapshot(path: str, node: str, records: DataFrame) -> None:
    """A snapshot of a log under path: the frames of its records (as encoded takes them) and the node that made it."""
    encoded(records).write.parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(node,)], "node string").coalesce(1).write.parquet(f"{path}/node")


def read_snapshot(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The node and the records (SCHEMA) of a snapshot, unchecked as if a peer had sent them; Corrupt where it names no node."""
    try:
        named = spark.read.parquet(f"{path}/node").take(1)
    except AnalysisException as e:
        raise codec.Corrupt(f"no snapshot in {path}") from e
    if not named:
        raise codec.Corrupt(f"the snapshot in {path} names no node")
    return named[0].node, decoded(spark.read.parquet(f"{path}/records"))


def round_trip(log: DataFrame) -> DataFrame:
    """(origin, seq, kind, ts) of a log after its records went through frames. Origins are hashed to keys, bodies name the ad."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "kind": b["kind"],
                    "origin": [hashlib.sha256(str(o).encode()).digest() for o in b["origin"]],
                    "seq": b["seq"],
                    "ts": b["ts"],
                    "body": [f'{{"ad":{a}}}'.encode() for a in b["ad"]],
                    "sig": [bytes(64)] * len(b),
                }
            )

    shaped = log.select("id", "kind", "origin", "seq", "ts", "ad").mapInPandas(whole, "id long, kind string, origin binary, seq long, ts long, body binary, sig binary")
    return decoded(encoded(shaped)).selectExpr("lower(hex(origin)) AS origin", "seq", "kind", "ts", "CAST(body AS STRING) AS body")
