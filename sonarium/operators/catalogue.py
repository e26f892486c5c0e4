"""The shared catalogue: last-writer-wins tables, trust, tracking, listings and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SELF_WEIGHT, UNKNOWN_WEIGHT, MIN_TRUST, FILE_MAP_MIN, MAX_ADS, CONFIRMED_SHARE = 10.0, 0.2, 1.0, 1.0, 1 << 18, 0.5
CLUSTER_MS = 250


# last writer wins


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The row of each key with the greatest (ts, seq)."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("newest_row")).select(*by, "newest_row.*")


def author(adds: DataFrame) -> DataFrame:
    """(ad, author, author_ts): who added each ad first; of equal times the least origin."""
    return adds.groupBy("ad").agg(F.min(F.struct("ts", "origin")).alias("x")).select("ad", F.col("x.origin").alias("author"), F.col("x.ts").alias("author_ts"))


def effective(base: DataFrame, claims: DataFrame, self_id: int, column: str) -> DataFrame:
    """base with column_eff: what the own node says, else the latest claim (by ts, then origin), else the base value."""
    order = F.struct((F.col("origin") == self_id).alias("own"), "ts", "origin")
    said = claims.groupBy(F.col("ad").alias("id")).agg(F.max_by(F.col(column), order).alias("said"))
    return base.join(said, "id", "left").withColumn(f"{column}_eff", F.coalesce("said", column)).drop("said")


def live_retractions(retractions: DataFrame, adds: DataFrame) -> DataFrame:
    """Retractions newer than the latest add of the same ad by the same origin."""
    a = adds.groupBy("ad", "origin").agg(F.max("ts").alias("added"))
    return retractions.join(a, ["ad", "origin"], "left").where(F.col("ts") > F.coalesce("added", F.lit(0))).drop("added")


# trust


def weight(self_id: int, blocked: Column, own: Column, origin: Column) -> Column:
    """The own node or no origin counts fully, a blocked one not at all, others by their weight, else as unknown."""
    return F.when(origin.isNull() | (origin == self_id), SELF_WEIGHT).when(F.coalesce(blocked, F.lit(False)), 0.0).otherwise(F.coalesce(own, F.lit(UNKNOWN_WEIGHT)))


def weighed(df: DataFrame, policy: DataFrame, self_id: int, origin: str = "origin") -> DataFrame:
    """df with w, the weight of its origin."""
    p = policy.select(F.col("origin").alias("p_origin"), F.col("weight").alias("p_weight"), F.col("blocked").alias("p_blocked"))
    joined = df.join(p, F.col(origin) == F.col("p_origin"), "left")
    return joined.withColumn("w", weight(self_id, F.col("p_blocked"), F.col("p_weight"), F.col(origin))).drop("p_origin", "p_weight", "p_blocked")


def confirming(peer: DataFrame, own: DataFrame, self_id: int) -> DataFrame:
    """Distinct (ad, origin) with a confirmed detection; the own node counts once."""
    mine = own.where("confirmed").select("ad", F.lit(self_id).cast("long").alias("origin"))
    return peer.where("confirmed").select("ad", "origin").unionByName(mine).distinct()


def trust(ads: DataFrame, votes: DataFrame, confirmations: DataFrame, policy: DataFrame, self_id: int) -> DataFrame:
    """(id, trust): weight of the author, votes by weight, half the weight of each origin that confirmed it.

    Sums are rounded to 9 digits, so that the order of addition cannot decide
    whether a threshold is met.
    """
    parts = [
        ads.select(F.col("id").alias("ad"), F.col("author").cast("long").alias("origin"), F.lit(1.0).alias("factor")),
        votes.select("ad", F.col("origin").cast("long").alias("origin"), F.col("value").cast("double").alias("factor")),
        confirmations.select("ad", F.col("origin").cast("long").alias("origin"), F.lit(CONFIRMED_SHARE).alias("factor")),
    ]
    each = weighed(parts[0].unionByName(parts[1]).unionByName(parts[2]), policy, self_id)
    summed = each.groupBy("ad").agg(F.sum(F.col("w") * F.col("factor")).alias("s"))
    return ads.select(F.col("id").alias("ad")).join(summed, "ad").select(F.col("ad").alias("id"), F.round("s", 9).alias("trust"))


def states(ads: DataFrame, dups: DataFrame, policy: DataFrame, retracted: DataFrame, self_id: int) -> DataFrame:
    """(id, state): active, or the strongest of dup (claimed by the own node), blocked (author), retracted (by the author, or nobody's)."""
    a = ads.select("id", "author")
    marks = dups.where(F.col("origin") == self_id).select(F.col("ad").alias("id"), F.lit(1).alias("rank"))
    marks = marks.unionByName(a.join(policy.where("blocked").select(F.col("origin").alias("author")), "author", "left_semi").where(F.col("author") != self_id).select("id", F.lit(2).alias("rank")))
    gone = a.join(retracted.select(F.col("ad").alias("id"), "origin"), "id").where(F.col("author").isNull() | (F.col("author") == F.col("origin"))).select("id", F.lit(3).alias("rank"))
    strongest = marks.unionByName(gone).groupBy("id").agg(F.max("rank").alias("rank"))
    names = F.element_at(F.array(*map(F.lit, ("active", "dup", "blocked", "retracted"))), F.coalesce("rank", F.lit(0)) + 1)
    return a.select("id").join(strongest, "id", "left").select("id", names.alias("state"))


def tracking(ads: DataFrame, scored: DataFrame, marked: DataFrame, pins: DataFrame, max_ads: int = MAX_ADS, least: float = MIN_TRUST) -> DataFrame:
    """(id, trust, pinned): active ads of enough trust or pinned; the first max_ads by pinned, trust, newness and id (0: all)."""
    p = pins.select(F.col("ad").alias("id"), F.lit(True).alias("pinned"))
    rows = ads.select("id", "created").join(scored, "id").join(marked.where("state = 'active'").select("id"), "id", "left_semi").join(p, "id", "left").fillna(False, ["pinned"])
    rows = rows.where(F.col("pinned") | (F.col("trust") >= least))
    if max_ads > 0:
        rows = rows.orderBy(F.desc("pinned"), F.desc("trust"), F.desc("created"), "id").limit(max_ads)
    return rows.select("id", "trust", "pinned")


def trash(votes: DataFrame, policy: DataFrame, self_id: int, least: float = MIN_TRUST) -> DataFrame:
    """Ads that a trusted origin voted down as no ad or badly cut."""
    bad = votes.where((F.col("value") < 0) & F.col("reason").isin("not_ad", "boundary"))
    return weighed(bad.select("ad", "origin").distinct(), policy, self_id).where(F.col("w") >= least).select("ad").distinct()


def called_dups(dups: DataFrame, policy: DataFrame, self_id: int, least: float = MIN_TRUST) -> DataFrame:
    return weighed(dups.select("ad", "origin").distinct(), policy, self_id).where(F.col("w") >= least).select("ad").distinct()


# clusters of peer detections


def anchored(starts: Column, width: int = CLUSTER_MS) -> Column:
    """For an ascending array, the anchor of each element: the first start of its cluster, which reaches width from there."""
    zero = F.struct(F.lit(None).cast("bigint").alias("a"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct(F.when(s["a"].isNull() | (x - s["a"] > width), x).otherwise(s["a"]).alias("a"), F.array_append(s["out"], F.when(s["a"].isNull() | (x - s["a"] > width), x).otherwise(s["a"])).alias("out"))
    return F.aggregate(starts, zero, step, lambda s: s["out"])


def members(dets: DataFrame) -> DataFrame:
    """(key, ad, anchor_ms, origin, best, confirmed, disagree): each origin's detections in a cluster, which starts within 250 ms of its first.

    A gap of more than 250 ms always begins a cluster, so the distinct starts
    of an ad in a file are cut there first, and only the starts of one such
    island are walked together.
    """
    by = Window.partitionBy("key", "ad").orderBy("start_ms")
    new = F.when(F.col("start_ms") - F.lag("start_ms").over(by) <= CLUSTER_MS, 0).otherwise(1)
    starts = dets.select("key", "ad", "start_ms").distinct().withColumn("new", new)
    starts = starts.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = starts.groupBy("key", "ad", "island").agg(F.sort_array(F.collect_list("start_ms")).alias("s"))
    anchors = islands.select("key", "ad", F.explode(F.arrays_zip("s", anchored(F.col("s")).alias("a"))).alias("z")).select("key", "ad", F.col("z.s").alias("start_ms"), F.col("z.a").alias("anchor_ms"))
    best = F.max_by(F.struct("start_ms", "end_ms", "score"), F.struct("score", (-F.col("start_ms")).alias("s"))).alias("best")
    return dets.join(anchors, ["key", "ad", "start_ms"]).groupBy("key", "ad", "anchor_ms", "origin").agg(best, F.max("confirmed").alias("confirmed"), (F.min("confirmed") != F.max("confirmed")).alias("disagree"))


def clustered(rows: DataFrame, policy: DataFrame, self_id: int) -> DataFrame:
    """members, one row for each cluster: the best score gives the interval; of equal scores the earliest start, then the least origin."""
    best = F.max_by("best", F.struct("best.score", (-F.col("best.start_ms")).alias("s"), (-F.col("origin")).alias("o"))).alias("best")
    disagree = (F.max("disagree") | (F.min("confirmed") != F.max("confirmed"))).alias("disagree")
    out = weighed(rows, policy, self_id).groupBy("key", "ad", "anchor_ms").agg(best, F.max("confirmed").alias("confirmed"), F.count("*").alias("origins"), F.round(F.sum("w"), 9).alias("weight"), disagree)
    return out.select("key", "ad", "anchor_ms", "best.*", "confirmed", "origins", "weight", "disagree")


def cluster(dets: DataFrame, policy: DataFrame, self_id: int) -> DataFrame:
    """(key, ad, anchor_ms, start_ms, end_ms, score, confirmed, origins, weight): detections of an ad that start within 250 ms of the first."""
    return clustered(members(dets), policy, self_id).drop("disagree")


def contradicted(found: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """(key, ad, anchor_ms) of the clusters that one of another ad and of more weight overlaps in time; they meet in buckets of time."""
    buckets = F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.greatest(F.col("start_ms"), F.col("end_ms") - 1) / bucket_ms))).alias("bucket")
    a, o = found.select("key", "ad", "anchor_ms", "start_ms", "end_ms", "weight", buckets).alias("a"), found.select("key", "ad", "start_ms", "end_ms", "weight", buckets).alias("o")
    against = (F.col("a.key") == F.col("o.key")) & (F.col("a.bucket") == F.col("o.bucket")) & (F.col("a.ad") != F.col("o.ad")) & (F.col("o.start_ms") < F.col("a.end_ms")) & (F.col("a.start_ms") < F.col("o.end_ms")) & (F.col("o.weight") > F.col("a.weight"))
    return a.join(o, against, "left_semi").select("key", "ad", "anchor_ms").distinct()


def digest(ids: DataFrame, column: str, head: str, digits: int = 2) -> DataFrame:
    """One row with the digest of a set of hex ids: that of the digests of its ranges by the first digits, each in order of ids, so that no task holds the whole set."""
    part = F.substring(column, 1, digits).alias("part")
    ranges = ids.groupBy(part).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias("d"))
    whole = ranges.agg(F.sort_array(F.collect_list(F.struct("part", "d"))).alias("r"))  # at most 16^digits rows
    return whole.select(F.sha2(F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["d"]), "")), 256).alias("digest"))


# listings


@dataclass
class AdQuery:
    """Filters of the ad list; empty means any. label is part of a folded label or an id prefix in hex."""

    label: str = ""
    fp_version: int = 0
    type: str = ""
    pinned: bool | None = None
    by_label: bool = False
    limit: int = 50
    offset: int = 0


def id_range(prefix: str) -> tuple[str, str] | None:
    """The least and greatest id with a hex prefix of 1 to 32 digits (dashes ignored); None if it is none."""
    digits = prefix.replace("-", "").lower()
    if not 1 <= len(digits) <= 32 or set(digits) - set("0123456789abcdef"):
        return None
    return digits.ljust(32, "0"), digits.ljust(32, "f")


def filtered(ads: DataFrame, pins: DataFrame, q: AdQuery) -> DataFrame:
    if q.label:
        cond = F.contains(F.lower("label"), F.lit(q.label.lower()))
        if span := id_range(q.label):
            cond = cond | F.col("hex_id").between(*span)
        ads = ads.where(cond)
    if q.fp_version:
        ads = ads.where(F.col("fp_version") == q.fp_version)
    if q.type:
        ads = ads.where(F.col("type") == q.type)
    if q.pinned is not None:
        ads = ads.join(pins.select(F.col("ad").alias("id")), "id", "left_semi" if q.pinned else "left_anti")
    return ads


def page(ads: DataFrame, pins: DataFrame, q: AdQuery) -> DataFrame:
    """One page of the ad list with its total: newest first, or by folded label; ids break ties."""
    rows = filtered(ads, pins, q)
    total = rows.agg(F.count("*").alias("total"))
    order = [F.lower("label"), "id"] if q.by_label else [F.desc("created"), "id"]
    # one row, whatever the list
    return rows.orderBy(*order).offset(q.offset).limit(q.limit).join(F.broadcast(total))


def votes_by_ad(votes: DataFrame) -> DataFrame:
    return votes.groupBy("ad").agg(F.count_if(F.col("value") > 0).alias("up"), F.count_if(F.col("value") < 0).alias("down"))


def files_by_ad(own: DataFrame, peer: DataFrame) -> DataFrame:
    return own.select("ad", "key").unionByName(peer.select("ad", "key")).groupBy("ad").agg(F.countDistinct("key").alias("files"))


def confirmations_by_ad(own: DataFrame, peer: DataFrame, self_id: int) -> DataFrame:
    return confirming(peer, own, self_id).groupBy("ad").agg(F.countDistinct("origin").alias("confirmations"))


def last_seen(own: DataFrame, file_maps: DataFrame, peer: DataFrame, peer_maps: DataFrame) -> DataFrame:
    a = own.join(file_maps, "key").select("ad", F.col("updated").alias("t"))
    b = peer.join(peer_maps, ["key", "origin"]).select("ad", F.col("ts").alias("t"))
    return a.unionByName(b).groupBy("ad").agg(F.max("t").alias("last_seen"))


def dup_pairs(dups: DataFrame, ads: DataFrame, self_id: int) -> DataFrame:
    """(ad, canonical, label, canonical_label) of the own node's claims."""
    c = ads.select(F.col("id").alias("canonical"), F.col("label").alias("canonical_label"))
    o = ads.select(F.col("id").alias("ad"), "label")
    return dups.where(F.col("origin") == self_id).select("ad", "canonical").join(c, "canonical").join(o, "ad").select("ad", "canonical", "label", "canonical_label")


def origins(policy: DataFrame, records: DataFrame, votes: DataFrame, ads: DataFrame, bad: DataFrame, dup_ads: DataFrame, retracted: DataFrame, self_id: int) -> DataFrame:
    """One row for the own node, each origin of a record, vote or ad, and each one with a policy."""
    flag = lambda d, name: d.select(F.col("ad").alias("id"), F.lit(1).cast("long").alias(name)).distinct()
    authored = ads.where("author IS NOT NULL").select("id", F.col("author").alias("origin"))
    gone = retracted.join(ads.select(F.col("id").alias("ad"), F.col("author").alias("origin")), ["ad", "origin"], "left_semi")
    marked = authored.join(flag(bad, "trashed"), "id", "left").join(flag(dup_ads, "dups"), "id", "left").join(flag(gone, "retracted"), "id", "left")
    one = F.lit(1).cast("long")
    rules = policy.select("origin", F.struct("name", "weight", "blocked", "managed").alias("rule"))
    rows = rules.unionByName(policy.sparkSession.range(self_id, self_id + 1).select(F.col("id").alias("origin")), True)
    rows = rows.unionByName(records.select("origin", one.alias("records"), F.col("received").alias("last_received")), True).unionByName(votes.select("origin", one.alias("votes")), True)
    rows = rows.unionByName(marked.select("origin", one.alias("ads"), "trashed", "dups", "retracted"), True)
    sums = [F.sum(c).alias(c) for c in ("records", "votes", "ads", "trashed", "dups", "retracted")]
    out = rows.groupBy("origin").agg(F.max("rule").alias("rule"), F.max("last_received").alias("last_received"), *sums).select("origin", "rule.*", "last_received", "records", "votes", "ads", "trashed", "dups", "retracted")
    w = F.round(weight(self_id, F.col("blocked"), F.col("weight"), F.col("origin")), 9)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "votes", "ads", "trashed", "dups", "retracted")]
    return out.select("origin", (F.col("origin") == self_id).alias("is_self"), F.coalesce("name", F.lit("")).alias("name"), w.alias("w"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("managed", F.lit(False)).alias("managed"), "last_received", *counts)


def files_report(file_maps: DataFrame, own: DataFrame, peer_maps: DataFrame, peer: DataFrame) -> DataFrame:
    """One row for each file of the own maps or the peers': the own duration if it is known, else the peers' longest."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = [
        file_maps.select("key", F.lit(1).cast("long").alias("own"), F.col("updated").alias("t"), F.col("duration_ms").alias("own_ms"), none.alias("peer_ms"), F.col("analyzed_ms"), zero.alias("ads"), zero.alias("peer_ads"), none.alias("origin")),
        own.join(file_maps.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("ads")).select("key", zero.alias("own"), none.alias("t"), none.alias("own_ms"), none.alias("peer_ms"), zero.alias("analyzed_ms"), "ads", zero.alias("peer_ads"), none.alias("origin")),
        peer_maps.select("key", zero.alias("own"), F.col("ts").alias("t"), none.alias("own_ms"), F.col("duration_ms").alias("peer_ms"), zero.alias("analyzed_ms"), zero.alias("ads"), zero.alias("peer_ads"), "origin"),
        peer.join(peer_maps.select("key", "origin"), ["key", "origin"], "left_semi").groupBy("key").agg(F.count("*").alias("peer_ads")).select("key", zero.alias("own"), none.alias("t"), none.alias("own_ms"), none.alias("peer_ms"), zero.alias("analyzed_ms"), zero.alias("ads"), "peer_ads", none.alias("origin")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    duration = F.coalesce(F.nullif(F.max("own_ms"), F.lit(0)), F.max("peer_ms"))
    return every.groupBy("key").agg((F.max("own") == 1).alias("own"), F.max("t").alias("updated"), duration.alias("duration_ms"), F.sum("analyzed_ms").alias("analyzed_ms"), F.sum("ads").alias("ads"), F.sum("peer_ads").alias("peer_ads"), F.countDistinct("origin").alias("origins"))


def relayed(records: DataFrame, bad: DataFrame) -> DataFrame:
    """(via, relayed, relayed_trash): distinct ads that came by way of each node."""
    pairs = records.where("kind = 'ad.add' AND via IS NOT NULL").select("via", "ad").distinct()
    return pairs.join(bad.select("ad", F.lit(1).alias("bad")), "ad", "left").groupBy("via").agg(F.count("*").alias("relayed"), F.count("bad").alias("relayed_trash"))


def resolve(keys: DataFrame, maps: DataFrame, aliases: DataFrame) -> DataFrame:
    """keys (asked) with the map that is filed under it or under the key that it is an alias of; its own key comes first."""
    names = maps.select("key", F.col("key").alias("asked"), F.lit(0).alias("prio")).unionByName(aliases.join(maps.select("key"), "key", "left_semi").select("key", F.col("alias").alias("asked"), F.lit(1).alias("prio")))
    return keys.join(names, "asked").groupBy("asked").agg(F.min(F.struct("prio", "key")).alias("x")).select("asked", F.col("x.key").alias("key"))


def names(peers: DataFrame, policy: DataFrame) -> DataFrame:
    """(origin, name): the name that the policy gives an origin, else that of the peer."""
    both = peers.select(F.col("node_id").alias("origin"), "name", F.lit(0).alias("prio")).unionByName(policy.where("name <> ''").select("origin", "name", F.lit(1).alias("prio")))
    return both.groupBy("origin").agg(F.max_by("name", F.struct("prio", "name")).alias("name"))
