"""Queries of the match family, on words as landmarks: benchmark items are the clips, documents the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as m
from .fixtures import ctes, tables, with_

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str):
    def keep(f):
        QUERIES[key] = f
        ORACLE[key] = sql
        return f

    return keep


POINTS = ("ad_points", "q_points")
_PAIRS = "pairs AS (SELECT q.q, p.ad, p.t - q.t AS off, q.h, q.t FROM q_points q JOIN ad_points p ON p.h = q.h)"
_VOTES = _PAIRS + ", votes AS (SELECT q, ad, off, count(*) AS v FROM pairs GROUP BY ALL)"
_PEAKS = _VOTES + """, near AS (SELECT v.*, coalesce(a.v, 0) AS prev, coalesce(b.v, 0) AS next FROM votes v
  LEFT JOIN votes a ON a.q = v.q AND a.ad = v.ad AND a.off = v.off - 1 LEFT JOIN votes b ON b.q = v.q AND b.ad = v.ad AND b.off = v.off + 1),
found AS (SELECT q, ad, off, prev + v + next AS score FROM near WHERE prev < v AND next <= v)"""


def _points(spark, sf):
    ads, q = tables(spark, sf, *POINTS)
    return ads, q


@query("J1", with_(*POINTS) + ", " + _PAIRS + " SELECT q, ad, off, h, t FROM pairs")
def j1(spark, sf):
    ads, q = _points(spark, sf)
    return m.join_postings(q, ads)


@query("J2", with_(*POINTS) + ", idx AS (SELECT * FROM ad_points WHERE ad % 7 <> 3) SELECT q.q, p.ad, p.t - q.t AS off, q.h, q.t FROM q_points q JOIN idx p ON p.h = q.h")
def j2(spark, sf):
    ads, q = _points(spark, sf)
    dead = ads.where("ad % 7 = 3").select("ad").distinct()
    return m.join_postings(q, m.live(ads.where("ad % 5 <> 0"), ads.where("ad % 5 = 0"), dead))


@query("G1", with_(*POINTS) + ", " + _VOTES + " SELECT q, ad, off, v FROM votes")
def g1(spark, sf):
    ads, q = _points(spark, sf)
    return m.vote(m.join_postings(q, ads))


@query("J22", with_(*POINTS) + ", " + _PEAKS + " SELECT q, ad, off, v, prev, next FROM near")
def j22(spark, sf):
    ads, q = _points(spark, sf)
    return m.neighbours(m.vote(m.join_postings(q, ads)))


@query("G2", with_(*POINTS) + ", " + _PEAKS + " SELECT q, ad, off, score FROM found WHERE score >= 8")
def g2(spark, sf):
    ads, q = _points(spark, sf)
    return m.match(q, ads, 8)


@query("G3", with_(*POINTS) + ", " + _PEAKS + " SELECT q, ad, off, score FROM found WHERE ad <> q % 40 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, ad, off) = 1")
def g3(spark, sf):
    ads, q = _points(spark, sf)
    return m.best_other(m.match(q, ads, 1).withColumn("own", F.col("q") % 40), "own")


@query("T4", with_(*POINTS) + ", " + _PEAKS + " SELECT q, ad, off, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, ad, off) AS INTEGER) AS rank FROM found WHERE score >= 3")
def t4(spark, sf):
    ads, q = _points(spark, sf)
    return m.ranked(m.match(q, ads, 3))


@query("P18", "WITH " + ctes("q_points") + " SELECT q, h, t FROM q_points WHERE h BETWEEN 0 AND 16777215 AND t BETWEEN 0 AND 16383")
def p18(spark, sf):
    return m.valid_postings(tables(spark, sf, "q_points")[0])


@query("T10", "WITH " + ctes("ad_points") + " SELECT ad, h, t FROM ad_points")
def t10(spark, sf):
    return m.index(tables(spark, sf, "ad_points")[0])


@query("G29", "WITH " + ctes("ad_points") + " SELECT count(DISTINCT ad) AS ads, count(*) AS postings, count(DISTINCT h) AS distinct_hashes FROM ad_points")
def g29(spark, sf):
    return m.statistics(tables(spark, sf, "ad_points")[0])


#: Frames are spread by 20 so that documents are several windows long.
_LONG = "long AS (SELECT q AS ad, h, t * 20 AS t FROM q_points), last AS (SELECT ad, max(t) AS last FROM long GROUP BY ad), wins AS (SELECT ad, unnest(range(0, 1 + greatest(0, CAST(ceil((last + 1 - 406) / 313.0) AS BIGINT)))) AS win FROM last)"


@query("W2", with_(*POINTS) + ", " + _LONG + " SELECT w.ad, w.win, l.h, l.t FROM wins w LEFT JOIN long l ON l.ad = w.ad AND l.t >= w.win * 313 AND l.t < w.win * 313 + 406")
def w2(spark, sf):
    _, q = _points(spark, sf)
    return m.quality_windows(q.select(F.col("q").alias("ad"), "h", (F.col("t") * 20).alias("t")))


_QUALITY = """, pts AS (SELECT ad, h, t * 20 AS t FROM ad_points), last AS (SELECT ad, max(t) AS last, count(*) AS n FROM pts GROUP BY ad),
wins AS (SELECT ad, unnest(range(0, 1 + greatest(0, CAST(ceil((last + 1 - 406) / 313.0) AS BIGINT)))) AS win FROM last),
inside AS (SELECT w.ad AS own, w.win, l.h, l.t FROM wins w JOIN pts l ON l.ad = w.ad AND l.t >= w.win * 313 AND l.t < w.win * 313 + 406),
votes AS (SELECT own, win, p.ad, p.t - i.t AS off, count(*) AS v FROM inside i JOIN pts p ON p.h = i.h GROUP BY ALL),
near AS (SELECT v.*, coalesce(a.v, 0) AS prev, coalesce(b.v, 0) AS next FROM votes v
  LEFT JOIN votes a ON a.own = v.own AND a.win = v.win AND a.ad = v.ad AND a.off = v.off - 1 LEFT JOIN votes b ON b.own = v.own AND b.win = v.win AND b.ad = v.ad AND b.off = v.off + 1),
found AS (SELECT own, win, ad, off, prev + v + next AS score FROM near WHERE prev < v AND next <= v),
selfs AS (SELECT w.ad, w.win, coalesce(max(f.score), 0) AS s FROM wins w LEFT JOIN found f ON f.own = w.ad AND f.win = w.win AND f.ad = w.ad GROUP BY ALL),
worst AS (SELECT own, ad, score, win FROM found WHERE ad <> own QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, win, ad) = 1),
quality AS (SELECT s.ad, count(*) AS windows, CAST(min(s.s) AS BIGINT) AS self_min, any_value(w.ad) AS worst_ad, CAST(coalesce(any_value(w.score), 0) AS BIGINT) AS worst_score, any_value(w.win) * 313 * 32 AS worst_at_ms,
  any_value(l.n) / ((any_value(l.last) + 1) * 0.032) AS points_per_s FROM selfs s LEFT JOIN worst w ON w.own = s.ad JOIN last l ON l.ad = s.ad GROUP BY s.ad)"""


@query("G30", with_("ad_points") + _QUALITY + " SELECT * FROM quality")
def g30(spark, sf):
    pts = tables(spark, sf, "ad_points")[0].withColumn("t", F.col("t") * 20)
    return m.quality(pts, pts)


@query("G31", with_("ad_points", "dups") + _QUALITY + " SELECT ad, worst_ad, worst_score FROM quality q WHERE worst_score >= 1 AND NOT EXISTS (SELECT 1 FROM dups d WHERE (d.ad = q.ad AND d.canonical = q.worst_ad) OR (d.ad = q.worst_ad AND d.canonical = q.ad))")
def g31(spark, sf):
    pts, dups = tables(spark, sf, "ad_points", "dups")
    pts = pts.withColumn("t", F.col("t") * 20)
    return m.possible_duplicates(m.quality(pts, pts), dups, 1)


@query(
    "R3",
    with_(*POINTS) + ", " + _PEAKS + """, placed AS (SELECT q, ad, off, score, 1000 - off * 32 AS start_ms, 1000 - off * 32 + 15000 + ad % 5 * 1000 AS end_ms, max(score) OVER (PARTITION BY q, ad) AS best FROM found WHERE score >= 2),
kept AS (SELECT *, least(14000, end_ms) - greatest(1000, start_ms) AS ov FROM placed WHERE score >= 0.8 * best)
SELECT q, ad, start_ms, end_ms, score FROM kept WHERE ov >= 1000 QUALIFY row_number() OVER (PARTITION BY q, ad ORDER BY score / ov DESC, score DESC, off) = 1""",
)
def r3(spark, sf):
    ads, q = _points(spark, sf)
    found = m.match(q, ads, 2).withColumns({"t0_ms": F.lit(1000), "dur_ms": F.lit(13000)})
    return m.pick(found, ads.select("ad").distinct().withColumn("ad_ms", 15000 + F.col("ad") % 5 * 1000))
