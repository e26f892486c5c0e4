"""Interval sets: union, gaps, coverage, shadows, bands, and the windows of the analyser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds: gaps that a union closes, slack of containment, gaps that count.
JOIN_GAP, SLACK, LEAST_GAP = 50, 50, 500
BLOCK, OVERLAP = 80_000, 24_000


def union(df: DataFrame, by: str, gap: int = JOIN_GAP) -> DataFrame:
    """(by, from_ms, to_ms): intervals joined where they overlap or lie at most gap apart."""
    w = Window.partitionBy(by).orderBy("from_ms", "to_ms")
    reach = F.max("to_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where("to_ms > from_ms").withColumn("new", F.when(reach.isNull() | (F.col("from_ms") > reach + gap), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(by, "island").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms")).drop("island")


def as_sets(islands: DataFrame, by: str) -> DataFrame:
    """(by, ranges array<struct<from_ms, to_ms>>) in order."""
    return islands.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("from_ms", "to_ms"))).alias("ranges"))


def contains(ranges: Column, low: Column, high: Column, slack: int = SLACK) -> Column:
    """Whether one range covers [low, high) but for slack at either end."""
    return F.exists(ranges, lambda r: (r["from_ms"] <= low + slack) & (r["to_ms"] >= high - slack))


def first_gap(ranges: Column, low: Column, high: Column, least: int = LEAST_GAP) -> Column:
    """struct<from_ms, to_ms> of the first stretch of [low, high) longer than least that no range covers; else null."""
    none = F.lit(None).cast("struct<from_ms:bigint,to_ms:bigint>")
    start = F.struct(low.cast("bigint").alias("at"), none.alias("gap"))

    def step(a: Column, r: Column) -> Column:
        end = F.least(r["from_ms"], high)
        gap = F.when(a["gap"].isNull() & (end - a["at"] > least), F.struct(a["at"].alias("from_ms"), end.alias("to_ms"))).otherwise(a["gap"])
        return F.struct(F.greatest(a["at"], r["to_ms"]).alias("at"), gap.alias("gap"))

    def last(a: Column) -> Column:
        return F.coalesce(a["gap"], F.when(high - a["at"] > least, F.struct(a["at"].alias("from_ms"), high.cast("bigint").alias("to_ms"))))

    return F.aggregate(ranges, start, step, last)


def covered_ms(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["to_ms"] - r["from_ms"])


def coverage_percent(analyzed: Column, duration: Column) -> Column:
    """Whole percent of duration, 100 at most, 0 if there is no duration."""
    return F.when(duration <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(analyzed * 100 / duration))).cast("bigint")


def without_shadowed(dets: DataFrame, by: str = "file") -> DataFrame:
    """Detections that no stronger one of another ad covers by half; of equal scores the earlier (ord) is stronger.

    Overlapping pairs are found by time buckets, so a long file does not pair everything with everything.
    """
    width = 60_000
    spread = lambda d: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / width))))
    a = spread(dets).alias("a")
    b = spread(dets.select(by, "ad", "start_ms", "end_ms", "score", "ord")).alias("b")
    overlap = F.least("a.end_ms", "b.end_ms") - F.greatest("a.start_ms", "b.start_ms")
    stronger = (F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.ord") < F.col("a.ord")))
    shadow = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.ad") != F.col("b.ad")) & stronger & (overlap > 0) & (2 * overlap >= F.col("a.end_ms") - F.col("a.start_ms")))
    hidden = shadow.select(F.col(f"a.{by}").alias(by), F.col("a.ord").alias("ord")).distinct()
    return dets.join(hidden, [by, "ord"], "left_anti")


def without_overlapping(remote: DataFrame, own: DataFrame, by: str = "key") -> DataFrame:
    """Remote detections that no own one of the same ad overlaps."""
    r, o = remote.alias("r"), own.alias("o")
    same = (F.col(f"r.{by}") == F.col(f"o.{by}")) & (F.col("r.ad") == F.col("o.ad"))
    return r.join(o, same & (F.col("r.start_ms") < F.col("o.end_ms")) & (F.col("o.start_ms") < F.col("r.end_ms")), "left_anti")


def without_near(remote: DataFrame, own: DataFrame, band: int = 250, by: str = "key") -> DataFrame:
    """Remote detections that start more than band from every own one of the same ad."""
    r, o = remote.alias("r"), own.alias("o")
    same = (F.col(f"r.{by}") == F.col(f"o.{by}")) & (F.col("r.ad") == F.col("o.ad"))
    return r.join(o, same & (F.abs(F.col("r.start_ms") - F.col("o.start_ms")) <= band), "left_anti")


def windows(files: DataFrame) -> DataFrame:
    """(file, win, low, high, from_n, to_n): the windows over n samples of each file.

    A full window holds BLOCK + OVERLAP samples and newly covers BLOCK of them;
    the last holds and covers all the rest.
    """
    k = F.greatest(F.lit(0), F.floor((F.col("n") - OVERLAP) / F.lit(BLOCK))).cast("long")
    each = files.where("n > 0").select("file", "n", k.alias("k")).select("file", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("win"))
    full, low = F.col("win") < F.col("k"), F.col("win") * BLOCK
    return each.select("file", "win", low.alias("low"), F.when(full, low + BLOCK + OVERLAP).otherwise(F.col("n")).alias("high"), low.alias("from_n"), F.when(full, low + BLOCK).otherwise(F.col("n")).alias("to_n"))


def sessions(chunks: DataFrame, by: str, jump: int) -> DataFrame:
    """chunks (by, from_ms, to_ms, ord) with run: a new run starts where the timeline jumps by more than jump, either way."""
    w = Window.partitionBy(by).orderBy("from_ms", "ord")
    gap = F.abs(F.col("from_ms") - F.lag("to_ms").over(w))
    return chunks.withColumn("run", F.sum(F.when(gap > jump, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
