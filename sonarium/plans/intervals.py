"""Queries of the interval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .fixtures import tables, with_

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str):
    def keep(f):
        QUERIES[key] = f
        ORACLE[key] = sql
        return f

    return keep


def _islands(gap: int) -> str:
    return f"""reach AS (SELECT *, max(to_ms) OVER (PARTITION BY file ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM intervals WHERE to_ms > from_ms),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR from_ms > r + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY from_ms, to_ms ROWS UNBOUNDED PRECEDING) AS island FROM reach),
islands AS (SELECT file, min(from_ms) AS from_ms, max(to_ms) AS to_ms FROM marked GROUP BY file, island)"""


@query("G20", with_("intervals") + ", " + _islands(50) + " SELECT * FROM islands")
def g20(spark, sf):
    return iv.union(tables(spark, sf, "intervals")[0], "file")


@query("G21", with_("intervals") + ", " + _islands(0) + " SELECT * FROM islands")
def g21(spark, sf):
    return iv.union(tables(spark, sf, "intervals")[0], "file", 0)


def _asked(spark, sf):
    x = tables(spark, sf, "intervals")[0]
    sets = iv.as_sets(iv.union(x, "file"), "file")
    return x.join(sets, "file")


@query("P11", with_("intervals") + ", " + _islands(50) + """ SELECT i.file, i.ord, EXISTS (SELECT 1 FROM islands s WHERE s.file = i.file AND s.from_ms <= i.from_ms - 30000 + 50 AND s.to_ms >= i.to_ms + 20 - 50) AS covered FROM intervals i""")
def p11(spark, sf):
    return _asked(spark, sf).select("file", "ord", iv.contains(F.col("ranges"), F.col("from_ms") - 30000, F.col("to_ms") + 20).alias("covered"))


@query("P12", with_("intervals") + ", " + _islands(50) + """ SELECT i.file, i.ord, EXISTS (SELECT 1 FROM islands s WHERE s.file = i.file AND s.from_ms <= i.from_ms AND s.to_ms >= i.to_ms + 20) AS covered FROM intervals i""")
def p12(spark, sf):
    return _asked(spark, sf).select("file", "ord", iv.contains(F.col("ranges"), F.col("from_ms"), F.col("to_ms") + 20, 0).alias("covered"))


_GAPS = """asked AS (SELECT file, min(from_ms) - 1000 AS low, max(to_ms) + 400 AS high FROM intervals WHERE to_ms > from_ms GROUP BY file),
edges AS (SELECT a.file, a.low, a.high, s.from_ms, s.to_ms FROM asked a JOIN islands s ON s.file = a.file UNION ALL SELECT file, low, high, high, high FROM asked),
gaps AS (SELECT file, greatest(low, coalesce(max(to_ms) OVER (PARTITION BY file ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low)) AS gap_from, least(from_ms, high) AS gap_to FROM edges)
SELECT file, min(gap_from) AS gap_from, arg_min(gap_to, gap_from) AS gap_to FROM gaps WHERE gap_to - gap_from > {least} GROUP BY file"""


@query("P13", with_("intervals") + ", " + _islands(50) + ", " + _GAPS.format(least=500))
def p13(spark, sf):
    x = tables(spark, sf, "intervals")[0].where("to_ms > from_ms")
    bounds = x.groupBy("file").agg((F.min("from_ms") - 1000).alias("low"), (F.max("to_ms") + 400).alias("high"))
    gap = iv.first_gap(F.col("ranges"), F.col("low"), F.col("high"))
    out = iv.as_sets(iv.union(x, "file"), "file").join(bounds, "file").select("file", gap.alias("g"))
    return out.where("g IS NOT NULL").select("file", F.col("g.from_ms").alias("gap_from"), F.col("g.to_ms").alias("gap_to"))


@query("G19", with_("intervals") + ", " + _islands(50) + " SELECT file, CAST(sum(to_ms - from_ms) AS BIGINT) AS analyzed_ms FROM islands GROUP BY file")
def g19(spark, sf):
    sets = iv.as_sets(iv.union(tables(spark, sf, "intervals")[0], "file"), "file")
    return sets.select("file", iv.covered_ms(F.col("ranges")).alias("analyzed_ms"))


@query("G18", with_("file_maps") + " SELECT key, CASE WHEN duration_ms <= 0 THEN 0 ELSE least(100, (analyzed_ms * 100) // duration_ms) END AS percent FROM file_maps")
def g18(spark, sf):
    return tables(spark, sf, "file_maps")[0].select("key", iv.coverage_percent(F.col("analyzed_ms"), F.col("duration_ms")).alias("percent"))


_DETS = ("dets",)


@query(
    "J13",
    with_("dets")
    + """SELECT * FROM dets a WHERE NOT EXISTS (SELECT 1 FROM dets b WHERE b.file = a.file AND b.ad <> a.ad AND (b.score > a.score OR (b.score = a.score AND b.ord < a.ord))
  AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 0 AND 2 * (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) >= a.end_ms - a.start_ms)""",
)
def j13(spark, sf):
    d = tables(spark, sf, "dets")[0].withColumn("ord", F.col("ord").cast("bigint"))
    return iv.without_shadowed(d).select("file", "ad", "start_ms", "end_ms", "score", "ord")


_BOTH = ("peer_detections", "own_detections")


@query("J12", with_(*_BOTH) + "SELECT * FROM peer_detections r WHERE NOT EXISTS (SELECT 1 FROM own_detections o WHERE o.key = r.key AND o.ad = r.ad AND r.start_ms < o.end_ms AND o.start_ms < r.end_ms)")
def j12(spark, sf):
    peer, own = tables(spark, sf, *_BOTH)
    return iv.without_overlapping(peer, own)


@query("J15", with_(*_BOTH) + "SELECT * FROM peer_detections r WHERE NOT EXISTS (SELECT 1 FROM own_detections o WHERE o.key = r.key AND o.ad = r.ad AND abs(r.start_ms - o.start_ms) <= 250)")
def j15(spark, sf):
    peer, own = tables(spark, sf, *_BOTH)
    return iv.without_near(peer, own)


@query(
    "W1",
    with_("samples")
    + """, k AS (SELECT file, n, greatest(0, CAST(floor((n - 24000) / 80000.0) AS BIGINT)) AS k FROM samples WHERE n > 0), w AS (SELECT file, n, k, unnest(range(0, k + 1)) AS win FROM k)
SELECT file, win, win * 80000 AS low, CASE WHEN win < k THEN win * 80000 + 104000 ELSE n END AS high, win * 80000 AS from_n, CASE WHEN win < k THEN win * 80000 + 80000 ELSE n END AS to_n FROM w""",
)
def w1(spark, sf):
    return iv.windows(tables(spark, sf, "samples")[0])


@query(
    "R5",
    with_("intervals")
    + """, g AS (SELECT *, abs(from_ms - lag(to_ms) OVER (PARTITION BY file ORDER BY from_ms, ord)) AS gap FROM intervals)
SELECT file, from_ms, to_ms, ord, CAST(sum(CASE WHEN gap > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY from_ms, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g""",
)
def r5(spark, sf):
    return iv.sessions(tables(spark, sf, "intervals")[0], "file", 500)
