"""Queries that run streams over the plain tables to their end and return what they leave."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, match
from ..streaming import detect as s
from . import catalogue, match as match_plans
from .fixtures import tables

QUERIES, ORACLE = {}, {}


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the driver and all executors share; only in local mode a temporary one stands in where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="sonarium-")


def _as_stream(df: DataFrame, folder: str, files: int = 3) -> DataFrame:
    """df written as files and read as a stream of so many files at a time."""
    df.write.parquet(f"{folder}/in")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return s.read(df.sparkSession, f"{folder}/in", schema, files)


def _told(rows: DataFrame, folder: str, *by: str) -> DataFrame:
    """What a stream in update mode has told last of each key once it has ended."""
    q = rows.writeStream.outputMode("update").foreachBatch(s.told_each(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.told_last(rows.sparkSession, f"{folder}/out", *by)


def g33_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Votes by last writer, from a stream."""
    folder = _folder(spark)
    stream = _as_stream(tables(spark, sf, "votes_log")[0], folder)
    return _told(s.latest(stream, "ad", "origin"), folder, "ad", "origin").select("ad", "origin", "value", "reason", "ts", "seq")


def r13_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of streamed documents against the index of benchmark items."""
    folder = _folder(spark)
    ads, q = tables(spark, sf, "ad_points", "q_points")
    # all landmarks of a document stay in one file
    stream = _as_stream(q.repartition("q"), folder)
    # the index as it is after ads were enrolled and one was removed: the overlay serves the new ones, the tombstone hides the old
    gone = ads.where("ad % 7 = 3").select("ad").distinct()
    index = ads.where("ad % 5 <> 0"), ads.where("ad % 5 = 0"), gone
    each = s.match_each(lambda: match.live(*index), 8, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("q", "ad", "off", "score")


def r1_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each file after the whole stream: those of the last batch that touched it."""
    folder = _folder(spark)
    stream = _as_stream(tables(spark, sf, "blocks")[0], folder)
    return _told(s.candidates(stream, idle_ms=None), folder, "file")


def r9_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Records that come twice, once each; those too far ahead are left out."""
    folder = _folder(spark)
    r = tables(spark, sf, "records")[0].select(F.col("id"), F.md5(F.col("id").cast("string")).alias("hash"), "ts")
    stream = _as_stream(r.unionByName(r), folder)
    unique = s.unique_records(stream.where(F.col("ts") <= 1_706_659_200_000 + ingest.AHEAD), "400 days").select("id", "hash", "ts")
    q = unique.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES |= {"G33_stream": g33_stream, "R13_stream": r13_stream, "R1_stream": r1_stream, "R9_stream": r9_stream}
ORACLE |= {
    "G33_stream": catalogue.ORACLE["G33"],
    "R13_stream": match_plans.ORACLE["G2"].replace("JOIN ad_points p ON p.h = q.h", "JOIN ad_points p ON p.h = q.h AND p.ad % 7 <> 3"),
    "R9_stream": "SELECT event_id AS id, md5(CAST(event_id AS VARCHAR)) AS hash, epoch_us(ts) // 1000 AS ts FROM events",
}
