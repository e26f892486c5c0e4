"""The record log: checks in their order of precedence, outcomes, and what records become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import folded

DAY, AHEAD, EARLIEST, MAX_BODY, MAX_KIND = 86_400_000, 600_000, 1_577_836_800_000, 204_800, 32


def envelope_reason(now: Column) -> Column:
    """The first failed check of (sig_ok, kind, seq, ts, body_len); null if there is none."""
    return (
        F.when(~F.col("sig_ok"), "signature")
        .when(~F.col("kind").rlike(rf"^[a-z._]{{1,{MAX_KIND}}}$") | (F.col("seq") == 0) | (F.col("ts") < EARLIEST), "invalid")
        .when(F.col("ts") > now + AHEAD, "future")
        .when(F.col("body_len") > MAX_BODY, "invalid")
    )


def outcomes(batch: DataFrame, stored: DataFrame, policy: DataFrame, now: int, quota: int, self_id: int) -> DataFrame:
    """batch with outcome: accepted, duplicate, or the reason of its rejection.

    Precedence: the same record already stored or earlier in the batch is a
    duplicate; then its own checks; a blocked origin; a number that another
    record of the origin has; the origin's quota over the last day by receive
    time, the batch in order of arrival included. The own node has no quota; a
    quota of 0 is none.
    """
    s = stored.select("origin", "seq", F.col("hash").alias("known"))
    own = Window.partitionBy("origin", "seq").orderBy("arrival")
    rows = batch.join(s, ["origin", "seq"], "left").withColumn("reason", envelope_reason(F.lit(now)))
    rows = rows.join(policy.where("blocked").select("origin", F.lit(True).alias("is_blocked")), "origin", "left")
    fine = F.col("reason").isNull() & F.col("is_blocked").isNull()
    # the hash that holds the number once this record comes: the stored one, or that of the first fine record before it
    first = F.first(F.when(fine, F.col("hash")), True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("holder", F.coalesce("known", first))
    early = F.when(F.col("holder") == F.col("hash"), "duplicate").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("is_blocked"), "blocked").when(F.col("holder").isNotNull(), "invalid")
    rows = rows.withColumn("early", early)
    recent = stored.where(F.col("received") > now - DAY).groupBy("origin").agg(F.count("*").alias("recent"))
    order = Window.partitionBy("origin").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum(F.when(F.col("early").isNull(), 1).otherwise(0)).over(order)
    over = (F.lit(quota) > 0) & (F.col("origin") != self_id) & (F.coalesce("recent", F.lit(0)) + rank > quota)
    rows = rows.join(recent, "origin", "left").withColumn("over", over)
    outcome = F.coalesce("early", F.when(F.col("over"), "quota").otherwise("accepted"))
    return rows.withColumn("outcome", outcome).select(*batch.columns, "outcome")


def tally(judged: DataFrame) -> DataFrame:
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


def materialized(log: DataFrame) -> dict[str, DataFrame]:
    """What the accepted records of a log become, whatever order they came in.

    log: id, origin, seq, ts, kind, ad, and by kind label, value, canonical,
    key and children (array<struct<ad, start_ms>>). Adds elect the earliest
    (ts, origin) as the author; labels, votes and duplicate claims keep each
    origin's latest by (ts, seq); retractions are a set; of the maps of a file
    each origin's latest counts, with its children only. Unknown kinds become
    nothing.
    """
    of = lambda kind: log.where(F.col("kind") == kind)
    newest = lambda kind, by, *rest: of(kind).groupBy(*by).agg(F.max_by(F.struct("ts", "seq", *rest), F.struct("ts", "seq")).alias("x")).select(*by, "x.*")
    first = F.min_by(F.struct(F.col("origin").alias("author"), F.col("ts").alias("author_ts"), "label", F.col("id").alias("record")), F.struct("ts", "origin", "seq")).alias("x")
    maps = newest("file.map", ["key", "origin"], "children")
    return {
        "ads": of("ad.add").groupBy("ad").agg(first).select("ad", "x.*"),
        "ad_adds": of("ad.add").groupBy("ad", "origin").agg(F.max("ts").alias("ts")),
        "labels": newest("ad.label", ["ad", "origin"], "label"),
        "votes": newest("ad.vote", ["ad", "origin"], "value"),
        "dups": newest("ad.dup", ["ad", "origin"], "canonical"),
        "retractions": of("ad.retract").select("ad", "origin", "ts").distinct(),
        "peer_maps": maps.drop("children"),
        "peer_detections": maps.select("key", "origin", F.inline("children")).distinct(),
    }


def next_numbers(records: DataFrame, wall: int) -> DataFrame:
    """(origin, seq, ts) of the next record of each origin: its number, and its clock, which is the wall time unless the origin has been ahead of it."""
    return records.groupBy("origin").agg((F.max("seq") + 1).alias("seq"), F.greatest(F.max("ts") + 1, F.lit(wall)).alias("ts"))


def ad_records(records: DataFrame) -> DataFrame:
    """(ad, record): ads that a record is filed under; a duplicate claim under both, file maps under none."""
    ads = F.when(F.col("kind") == "ad.dup", F.array("ad", "canonical")).when(F.col("kind") == "file.map", F.array().cast("array<bigint>")).otherwise(F.array("ad"))
    return records.select(F.explode(F.array_distinct(ads)).alias("ad"), F.col("id").alias("record"))


def after(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next records of the log in order of receipt."""
    return log.where(F.col("id") > cursor).orderBy("id").limit(limit)


def to_push(log: DataFrame, peer: int, cursor: int, limit: int = 500) -> DataFrame:
    """What to send a peer next: nothing that came by way of it."""
    return after(log.where(F.col("via").isNull() | (F.col("via") != peer)), cursor, limit)


def merged_detections(dets: DataFrame) -> DataFrame:
    """One row for (key, ad, start_ms): the greatest score, confirmed if any is, the end that came last by ord."""
    return dets.groupBy("key", "ad", "start_ms").agg(F.max("score").alias("score"), F.max("confirmed").alias("confirmed"), F.max_by("end_ms", "ord").alias("end_ms"))


def merge_counts(old: Column, new: Column) -> Column:
    """Counters by reason, added up."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def refile(keys: DataFrame, aliases: DataFrame, key: str, own_aliases: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, aliases) after a map is filed under key with aliases.

    Every stored map that these names reach goes, and its key and aliases
    become aliases of the new key.
    """
    spark = keys.sparkSession
    names = spark.createDataFrame([(x,) for x in {key, *own_aliases}], "name string")
    reached = keys.join(names.withColumnRenamed("name", "key"), "key", "left_semi").unionByName(aliases.join(names.withColumnRenamed("name", "alias"), "alias", "left_semi").select("key")).distinct()
    gone = reached.select(F.col("key").alias("alias")).unionByName(aliases.join(reached, "key", "left_semi").select("alias")).unionByName(names.select(F.col("name").alias("alias"))).distinct()
    new_aliases = aliases.join(reached, "key", "left_anti").select("alias", "key").unionByName(gone.where(F.col("alias") != key).select("alias", F.lit(key).alias("key")))
    new_keys = keys.join(reached, "key", "left_anti").unionByName(spark.createDataFrame([(key,)], "key string")).distinct()
    return new_keys, new_aliases


def adopted(files: DataFrame, provisional: str = "session:") -> DataFrame:
    """files (key, aliases, content, ...) after their content key is known: a provisional key gives way to it, any other takes it as an alias.

    A content key that is the key or an alias already, or null, changes nothing.
    """
    known = F.col("content").isNull() | (F.col("key") == F.col("content")) | F.array_contains("aliases", F.col("content"))
    passing = F.col("key").startswith(provisional)
    key = F.when(~known & passing, F.col("content")).otherwise(F.col("key"))
    aliases = F.when(~known & ~passing, F.array_append("aliases", F.col("content"))).otherwise(F.col("aliases"))
    return files.withColumns({"key": key, "aliases": aliases})


def rescanned(maps: DataFrame, enrolled: DataFrame) -> DataFrame:
    """maps (key, updated, analyzed_ms, ...) after enrolments (ts): what was analysed up to the last of them counts no more."""
    # newest is one row
    rows = maps.join(F.broadcast(enrolled.agg(F.max("ts").alias("newest"))))
    return rows.withColumn("analyzed_ms", F.when(F.col("updated") <= F.col("newest"), F.lit(0)).otherwise(F.col("analyzed_ms"))).drop("newest")


def debounced(triggers: DataFrame, wait_ms: int) -> DataFrame:
    """(node, fired): triggers (node, ms) that come while a call is pending are served by it, wait_ms after the one that set it up.

    Triggers wait_ms or more after the one before set up a call whatever came
    earlier, so stretches between such are folded apart.
    """
    w = Window.partitionBy("node").orderBy("ms")
    rows = triggers.withColumn("first", F.when(F.col("ms") - F.lag("ms").over(w) < wait_ms, 0).otherwise(1))
    rows = rows.withColumn("stretch", F.sum("first").over(w.rangeBetween(Window.unboundedPreceding, 0))).select("node", "stretch", "ms")

    def fold(held: list[tuple]) -> list[tuple]:
        fired: list[tuple] = []
        for node, _, ms in held:
            if not fired or ms >= fired[-1][1]:
                fired.append((node, ms + wait_ms))
        return fired

    return folded(rows, ["node", "stretch"], ["ms"], fold, "node long, fired long")


def near_reports(reports: DataFrame, existing: DataFrame, reach: int = 10_000, rank: Callable[[Column, Column], Column] = F.struct) -> DataFrame:
    """reports with target: of the existing reports of the same user and file within reach, the first by rank of its distance and id; else null.

    Without another rank that is the nearest, the earlier id of equal ones.
    Positions are bucketed by reach, so each report meets the three buckets
    around it only.
    """
    own = ["id", "user", "file_key", "pos_ms"]
    e = existing.select(F.col("user").alias("u"), F.col("file_key").alias("f"), F.col("pos_ms").alias("p"), F.col("id").alias("target")).withColumn("bucket", F.floor(F.col("p") / reach))
    asked = reports.withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("pos_ms") / reach) + d)))
    away = F.abs(F.col("pos_ms") - F.col("p"))
    hits = asked.join(e, (asked["user"] == e["u"]) & (asked["file_key"] == e["f"]) & (asked["bucket"] == e["bucket"]) & (away <= reach) & (F.col("id") != F.col("target")))
    best = hits.groupBy(own).agg(F.min(F.struct(rank(away, F.col("target")).alias("rank"), away.alias("d"), "target")).alias("best")).select(*own, F.col("best.target").alias("target"))
    return reports.join(best, own, "left")
