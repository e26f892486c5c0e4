"""Landmark matching: postings, offset votes, peaks.

A landmark is a hash h at a frame t. Where a clip occurs in a query, many of
its landmarks agree on the offset t(clip) - t(query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a posting: 24 bits of hash, 14 bits of frame.
MAX_HASH, MAX_FRAME = (1 << 24) - 1, (1 << 14) - 1
WINDOW_FRAMES, STEP_FRAMES = 406, 313
FRAME_MS = 32


def valid_postings(postings: DataFrame) -> DataFrame:
    """Postings within the limits of the index."""
    return postings.where(F.col("h").between(0, MAX_HASH) & F.col("t").between(0, MAX_FRAME))


def index(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings grouped by hash and sorted, as the index is stored."""
    dealt = postings.repartition(partitions, "h") if partitions else postings.repartition("h")
    return dealt.sortWithinPartitions("h", "ad", "t")


def live(base: DataFrame, delta: DataFrame, dead: DataFrame) -> DataFrame:
    """The index with newer postings, without the ads that are gone."""
    return base.unionByName(delta).join(dead.select("ad"), "ad", "left_anti")


def join_postings(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, ad, off, h, t) for every query landmark and posting of equal hash; repeated landmarks count repeatedly.

    Landmarks that no posting has are dropped before the exploding join by the
    join itself; which side is broadcast is left to the planner.
    """
    p = postings.select("h", "ad", F.col("t").alias("ad_t"))
    return query.join(p, "h").select("q", "ad", (F.col("ad_t") - F.col("t")).alias("off"), "h", "t")


def vote(matched: DataFrame, by: tuple[str, ...] = ("q", "ad")) -> DataFrame:
    """Votes for each offset."""
    return matched.groupBy(*by, "off").agg(F.count("*").alias("v"))


def peaks(votes: DataFrame, min_score: int, by: tuple[str, ...] = ("q", "ad")) -> DataFrame:
    """(by, off, score): offsets with more votes than the one before and no fewer than the next; the score sums the three.

    Neighbours are the offsets just one away: a frame by value finds them in
    one pass over the votes of a pair.
    """
    w = Window.partitionBy(*by).orderBy("off")
    prev = F.coalesce(F.sum("v").over(w.rangeBetween(-1, -1)), F.lit(0))
    after = F.coalesce(F.sum("v").over(w.rangeBetween(1, 1)), F.lit(0))
    found = votes.withColumn("prev", prev).withColumn("next", after)
    found = found.where((F.col("prev") < F.col("v")) & (F.col("next") <= F.col("v")))
    return found.withColumn("score", F.col("prev") + F.col("v") + F.col("next")).where(F.col("score") >= min_score).select(*by, "off", "score")


def neighbours(votes: DataFrame, by: tuple[str, ...] = ("q", "ad")) -> DataFrame:
    """votes with the votes of the offsets one before and one after, by joins on the shifted offset."""
    shifted = lambda d, name: votes.select(*by, (F.col("off") + d).alias("off"), F.col("v").alias(name))
    joined = votes.join(shifted(1, "prev"), [*by, "off"], "left").join(shifted(-1, "next"), [*by, "off"], "left")
    return joined.fillna(0, ["prev", "next"])


def match(query: DataFrame, postings: DataFrame, min_score: int) -> DataFrame:
    """(q, ad, off, score): where clips occur in queries."""
    return peaks(vote(join_postings(query, postings)), min_score)


def ranked(matches: DataFrame) -> DataFrame:
    """matches with their rank in each query: by score, of equal ones by ad and offset."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ad", "off")))


def best_other(matches: DataFrame, own: str) -> DataFrame:
    """(q, ad, off, score): the best match of each query that is not its own ad; the least ad and offset of equal ones."""
    best = F.max_by(F.struct("ad", "off", "score"), F.struct("score", (-F.col("ad")).alias("a"), (-F.col("off")).alias("o"))).alias("m")
    return matches.where(F.col("ad") != F.col(own)).groupBy("q").agg(best).select("q", "m.*")


def statistics(postings: DataFrame) -> DataFrame:
    """One row: ads, postings and distinct hashes of an index."""
    return postings.agg(F.countDistinct("ad").alias("ads"), F.count("*").alias("postings"), F.countDistinct("h").alias("distinct_hashes"))


def quality_windows(points: DataFrame) -> DataFrame:
    """(ad, win, h, t): landmarks in windows of WINDOW_FRAMES every STEP_FRAMES, the last being the first that reaches the end."""
    last = points.groupBy("ad").agg(F.max("t").alias("last"))
    count = F.greatest(F.lit(0), F.ceil((F.col("last") + 1 - WINDOW_FRAMES) / F.lit(STEP_FRAMES))).cast("long")
    windows = last.select("ad", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("win"))
    own = points.withColumn("low", F.greatest(F.lit(0), F.floor((F.col("t") - WINDOW_FRAMES) / F.lit(STEP_FRAMES)) + 1)).withColumn("high", F.floor(F.col("t") / F.lit(STEP_FRAMES)))
    placed = own.where("low <= high").select("ad", F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long"))).alias("win"), "h", "t")
    return windows.join(placed, ["ad", "win"], "left")


def quality(points: DataFrame, postings: DataFrame) -> DataFrame:
    """(ad, windows, self_min, worst_ad, worst_score, worst_at_ms, points_per_s): how well each ad stands out.

    self_min is the weakest window's score against the ad itself; worst the
    strongest match of another ad in any window, of equal ones the earliest
    window and then the least ad.
    """
    windows = quality_windows(points)
    key = F.struct("ad", "win")
    matches = match(windows.where("h IS NOT NULL").select(key.alias("q"), "h", "t"), postings, 1)
    matches = matches.select(F.col("q.ad").alias("own"), F.col("q.win").alias("win"), "ad", "score")
    mine = matches.where("ad = own").groupBy("own", "win").agg(F.max("score").alias("s"))
    each = windows.select(F.col("ad").alias("own"), "win").distinct().join(mine, ["own", "win"], "left").fillna(0, ["s"])
    weakest = each.groupBy("own").agg(F.count("*").alias("windows"), F.min("s").alias("self_min"))
    worst = matches.where("ad <> own").groupBy("own").agg(F.max_by(F.struct("ad", "score", "win"), F.struct("score", (-F.col("win")).alias("w"), (-F.col("ad")).alias("a"))).alias("m"))
    rate = points.groupBy(F.col("ad").alias("own")).agg((F.count("*") / ((F.max("t") + 1) * (FRAME_MS / 1000))).alias("points_per_s"))
    out = weakest.join(worst, "own", "left").join(rate, "own")
    return out.select(F.col("own").alias("ad"), "windows", "self_min", F.col("m.ad").alias("worst_ad"), F.coalesce("m.score", F.lit(0)).alias("worst_score"), (F.col("m.win") * STEP_FRAMES * FRAME_MS).alias("worst_at_ms"), "points_per_s")


def possible_duplicates(measured: DataFrame, known: DataFrame, min_score: int) -> DataFrame:
    """(ad, worst_ad, worst_score): ads that another one matches well, unless the pair is known either way."""
    pairs = known.select(F.col("ad"), F.col("canonical").alias("worst_ad"))
    both = pairs.unionByName(pairs.select(F.col("worst_ad").alias("ad"), F.col("ad").alias("worst_ad"))).distinct()
    return measured.where(F.col("worst_score") >= min_score).select("ad", "worst_ad", "worst_score").join(both, ["ad", "worst_ad"], "left_anti")


def pick(matches: DataFrame, ads: DataFrame) -> DataFrame:
    """One alignment for each ad and window: (q, ad, start_ms, end_ms, score).

    matches: (q, t0_ms, dur_ms, ad, off, score); ads: (ad, ad_ms). Of matches
    with at least 0.8 of the best score that overlap the window by a second or
    more, the one with most score for each second of overlap; of equal ones the
    higher score, then the least offset.
    """
    w = Window.partitionBy("q", "ad")
    start = F.col("t0_ms") - F.col("off") * FRAME_MS
    placed = matches.join(ads, "ad").withColumn("best", F.max("score").over(w)).withColumn("start_ms", start).withColumn("end_ms", start + F.col("ad_ms"))
    placed = placed.withColumn("ov", F.least(F.col("t0_ms") + F.col("dur_ms"), F.col("end_ms")) - F.greatest("t0_ms", "start_ms"))
    kept = placed.where((F.col("score") >= 0.8 * F.col("best")) & (F.col("ov") >= 1000))
    chosen = F.max_by(F.struct("start_ms", "end_ms", "score"), F.struct((F.col("score") / F.col("ov")).alias("d"), "score", (-F.col("off")).alias("o"))).alias("m")
    return kept.groupBy("q", "ad").agg(chosen).select("q", "ad", "m.*")
