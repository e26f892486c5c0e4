"""Queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as c
from .fixtures import SELF, tables, with_

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str):
    def keep(f):
        QUERIES[key] = f
        ORACLE[key] = sql
        return f

    return keep


_W = f"CASE WHEN {{o}} IS NULL OR {{o}} = {SELF} THEN 10.0 WHEN coalesce({{p}}.blocked, false) THEN 0.0 ELSE coalesce({{p}}.weight, 0.2) END"


def w(origin: str, policy: str = "p") -> str:
    return "CAST(" + _W.format(o=origin, p=policy) + " AS DOUBLE)"


_VOTES = "votes AS (SELECT * FROM votes_log QUALIFY row_number() OVER (PARTITION BY ad, origin ORDER BY ts DESC, seq DESC) = 1)"
_LIVE = "live AS (SELECT r.* FROM retractions r LEFT JOIN ad_adds a ON a.ad = r.ad AND a.origin = r.origin WHERE r.ts > coalesce(a.ts, 0))"
_CONFIRMING = f"confirming AS (SELECT ad, origin FROM peer_detections WHERE confirmed UNION SELECT ad, CAST({SELF} AS BIGINT) FROM own_detections WHERE confirmed)"
_TRUST = f"""parts AS (SELECT a.id, {w("a.author")} AS w FROM ads a LEFT JOIN origin_policy p ON p.origin = a.author
  UNION ALL SELECT v.ad, v.value * {w("v.origin")} FROM votes v LEFT JOIN origin_policy p ON p.origin = v.origin
  UNION ALL SELECT x.ad, 0.5 * {w("x.origin")} FROM confirming x LEFT JOIN origin_policy p ON p.origin = x.origin),
trust AS (SELECT a.id, round(sum(w), 9) AS trust FROM ads a JOIN parts USING (id) GROUP BY a.id)"""
_STATES = f"""marks AS (SELECT ad AS id, 1 AS rank FROM dups WHERE origin = {SELF} UNION ALL SELECT a.id, 2 FROM ads a JOIN origin_policy p ON p.origin = a.author WHERE p.blocked AND a.author <> {SELF}
  UNION ALL SELECT a.id, 3 FROM ads a JOIN live l ON l.ad = a.id WHERE a.author IS NULL OR a.author = l.origin),
states AS (SELECT a.id, CASE max(coalesce(m.rank, 0)) WHEN 0 THEN 'active' WHEN 1 THEN 'dup' WHEN 2 THEN 'blocked' ELSE 'retracted' END AS state FROM ads a LEFT JOIN marks m ON m.id = a.id GROUP BY a.id)"""
_TRASH = f"trash AS (SELECT DISTINCT v.ad FROM votes v LEFT JOIN origin_policy p ON p.origin = v.origin WHERE v.value < 0 AND v.reason IN ('not_ad', 'boundary') AND {w('v.origin')} >= 1.0)"
_DUPADS = f"dup_ads AS (SELECT DISTINCT d.ad FROM dups d LEFT JOIN origin_policy p ON p.origin = d.origin WHERE {w('d.origin')} >= 1.0)"


def _sql(fixtures: str, *parts: str, then: str) -> str:
    return with_(*fixtures.split()) + "".join(", " + p for p in parts) + "\n" + then


def _get(spark, sf, names: str):
    return tables(spark, sf, *names.split())


def _voted(spark, sf):
    return c.latest(_get(spark, sf, "votes_log")[0], "ad", "origin")


@query("G33", _sql("votes_log", _VOTES, then="SELECT ad, origin, value, reason, ts, seq FROM votes"))
def g33(spark, sf):
    return _voted(spark, sf).select("ad", "origin", "value", "reason", "ts", "seq")


@query("G34", _sql("ad_adds", then="SELECT ad, arg_min(origin, ts * 100000 + origin) AS author, min(ts) AS author_ts FROM ad_adds GROUP BY ad"))
def g34(spark, sf):
    return c.author(_get(spark, sf, "ad_adds")[0])


@query("G35", "SELECT o_orderkey % 300 AS ad, o_custkey % 50 AS origin, max(epoch_us(o_orderdate) // 1000) AS ts FROM orders GROUP BY 1, 2")
def g35(spark, sf):
    o = _get(spark, sf, "orders")[0]
    ts = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.groupBy((F.col("o_orderkey") % 300).alias("ad"), (F.col("o_custkey") % 50).alias("origin")).agg(F.max(ts).alias("ts"))


_EFFECTIVE = f"""said AS (SELECT ad, arg_max(label, (CASE WHEN origin = {SELF} THEN 1 ELSE 0 END, ts, origin)) AS said FROM (SELECT * FROM labels_log QUALIFY row_number() OVER (PARTITION BY ad, origin ORDER BY ts DESC, seq DESC) = 1) GROUP BY ad)"""


@query("P6", _sql("ads labels_log", _EFFECTIVE, then="SELECT a.id, a.label, coalesce(s.said, a.label) AS label_eff FROM ads a LEFT JOIN said s ON s.ad = a.id"))
def p6(spark, sf):
    ads, log = _get(spark, sf, "ads labels_log")
    return c.effective(ads, c.latest(log, "ad", "origin"), SELF, "label").select("id", "label", "label_eff")


@query("X4", _sql("ads labels_log", _EFFECTIVE, then="SELECT a.id, coalesce(s.said, a.label) AS label_eff FROM ads a LEFT JOIN said s ON s.ad = a.id WHERE a.id IN (SELECT ad FROM labels_log)"))
def x4(spark, sf):
    ads, log = _get(spark, sf, "ads labels_log")
    some = ads.join(log.select(F.col("ad").alias("id")).distinct(), "id", "left_semi")
    return c.effective(some, c.latest(log, "ad", "origin"), SELF, "label").select("id", "label_eff")


@query("P7", "SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS label_fold FROM part")
def p7(spark, sf):
    return _get(spark, sf, "ads")[0].select("id", F.lower("label").alias("label_fold"))


@query("P5", _sql("retractions ad_adds", _LIVE, then="SELECT ad, origin, ts FROM live"))
def p5(spark, sf):
    return c.live_retractions(*_get(spark, sf, "retractions ad_adds"))


@query("J7", _sql("retractions ad_adds ads", _LIVE, then="SELECT DISTINCT l.ad FROM live l JOIN ads a ON a.id = l.ad AND a.author = l.origin"))
def j7(spark, sf):
    r, adds, ads = _get(spark, sf, "retractions ad_adds ads")
    return c.live_retractions(r, adds).join(ads.select(F.col("id").alias("ad"), F.col("author").alias("origin")), ["ad", "origin"], "left_semi").select("ad").distinct()


@query("J20", _sql("peer_detections origin_policy", then=f"SELECT d.key, d.origin, d.ad, d.start_ms, {w('d.origin')} AS w FROM peer_detections d LEFT JOIN origin_policy p ON p.origin = d.origin"))
def j20(spark, sf):
    d, p = _get(spark, sf, "peer_detections origin_policy")
    return c.weighed(d, p, SELF).select("key", "origin", "ad", "start_ms", F.col("w").cast("double").alias("w"))


@query("U2", _sql("peer_detections own_detections", _CONFIRMING, then="SELECT ad, origin FROM confirming"))
def u2(spark, sf):
    peer, own = _get(spark, sf, "peer_detections own_detections")
    return c.confirming(peer, own, SELF)


_TRUSTED = "ads votes_log peer_detections own_detections origin_policy"


def _trust(spark, sf):
    ads, _, peer, own, policy = _get(spark, sf, _TRUSTED)
    return ads, policy, c.trust(ads, _voted(spark, sf), c.confirming(peer, own, SELF), policy, SELF)


@query("G4", _sql(_TRUSTED, _VOTES, _CONFIRMING, _TRUST, then="SELECT id, trust FROM trust"))
def g4(spark, sf):
    return _trust(spark, sf)[2]


_STATED = "ads dups retractions ad_adds origin_policy"


def _states(spark, sf):
    ads, dups, r, adds, policy = _get(spark, sf, _STATED)
    return c.states(ads, dups, policy, c.live_retractions(r, adds), SELF)


@query("G5", _sql(_STATED, _LIVE, _STATES, then="SELECT id, state FROM states"))
def g5(spark, sf):
    return _states(spark, sf)


_TRACKED = "ads votes_log peer_detections own_detections origin_policy dups retractions ad_adds pins"


def _tracking(limit: int) -> str:
    return f"""tracking AS (SELECT a.id, t.trust, n.ad IS NOT NULL AS pinned FROM ads a JOIN trust t ON t.id = a.id JOIN states s ON s.id = a.id LEFT JOIN pins n ON n.ad = a.id
  WHERE s.state = 'active' AND (n.ad IS NOT NULL OR t.trust >= 1.0) ORDER BY n.ad IS NOT NULL DESC, t.trust DESC, a.created DESC, a.id LIMIT {limit})"""


_ALL = (_VOTES, _CONFIRMING, _TRUST, _LIVE, _STATES)


def _tracked(spark, sf, limit):
    ads, _, scored = _trust(spark, sf)
    return c.tracking(ads, scored, _states(spark, sf), _get(spark, sf, "pins")[0], limit)


@query("T1", _sql(_TRACKED, *_ALL, _tracking(300), then="SELECT id, trust, pinned FROM tracking"))
def t1(spark, sf):
    return _tracked(spark, sf, 300)


@query("J17", _sql(_TRACKED, *_ALL, _tracking(262144), then="SELECT d.key, d.ad, d.start_ms, d.origin, a.label, a.type FROM peer_detections d JOIN tracking t ON t.id = d.ad JOIN ads a ON a.id = d.ad"))
def j17(spark, sf):
    kept = _tracked(spark, sf, c.MAX_ADS).select(F.col("id").alias("ad"))
    d, ads = _get(spark, sf, "peer_detections ads")
    return d.join(kept, "ad").join(ads.select(F.col("id").alias("ad"), "label", "type"), "ad").select("key", "ad", "start_ms", "origin", "label", "type")


@query("U7", _sql(_TRACKED, *_ALL, _tracking(262144), then="SELECT a.id, CASE WHEN t.id IS NOT NULL THEN a.label END AS label, CASE WHEN t.id IS NOT NULL THEN a.type END AS type, t.id IS NOT NULL AS ok FROM ads a LEFT JOIN tracking t ON t.id = a.id"))
def u7(spark, sf):
    """Label and type of every ad that is asked for, if it is tracked."""
    kept = _tracked(spark, sf, c.MAX_ADS).select("id", F.lit(True).alias("found"))
    rows = _get(spark, sf, "ads")[0].join(kept, "id", "left").withColumn("ok", F.coalesce("found", F.lit(False)))
    return rows.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("type")).alias("type"), "ok")


@query("T2", _sql("ads", then="SELECT id FROM ads ORDER BY created DESC, id LIMIT 262144"))
def t2(spark, sf):
    """The newest ads, where there are more than an index takes."""
    return _get(spark, sf, "ads")[0].orderBy(F.desc("created"), "id").limit(c.MAX_ADS).select("id")


@query("G13", _sql("votes_log origin_policy", _VOTES, _TRASH, then="SELECT ad FROM trash"))
def g13(spark, sf):
    return c.trash(_voted(spark, sf), _get(spark, sf, "origin_policy")[0], SELF)


_CLUSTER = f"""starts AS (SELECT key, ad, start_ms, row_number() OVER (PARTITION BY key, ad ORDER BY start_ms) AS n FROM (SELECT DISTINCT key, ad, start_ms FROM peer_detections)),
walk AS (SELECT key, ad, n, start_ms, start_ms AS anchor_ms FROM starts WHERE n = 1 UNION ALL
  SELECT s.key, s.ad, s.n, s.start_ms, CASE WHEN s.start_ms - w.anchor_ms > 250 THEN s.start_ms ELSE w.anchor_ms END FROM walk w JOIN starts s ON s.key = w.key AND s.ad = w.ad AND s.n = w.n + 1),
members AS (SELECT d.*, w.anchor_ms FROM peer_detections d JOIN walk w ON w.key = d.key AND w.ad = d.ad AND w.start_ms = d.start_ms),
best AS (SELECT key, ad, anchor_ms, start_ms, end_ms, score FROM members QUALIFY row_number() OVER (PARTITION BY key, ad, anchor_ms ORDER BY score DESC, start_ms, origin) = 1),
sums AS (SELECT m.key, m.ad, m.anchor_ms, count(*) AS origins, round(sum({w("m.origin")}), 9) AS weight FROM (SELECT DISTINCT key, ad, anchor_ms, origin FROM members) m LEFT JOIN origin_policy p ON p.origin = m.origin GROUP BY ALL),
ors AS (SELECT key, ad, anchor_ms, bool_or(confirmed) AS confirmed FROM members GROUP BY ALL),
clusters AS (SELECT b.*, o.confirmed, s.origins, s.weight FROM best b JOIN ors o USING (key, ad, anchor_ms) JOIN sums s USING (key, ad, anchor_ms))"""


@query("G16", _sql("peer_detections origin_policy", _CLUSTER, then="SELECT key, ad, anchor_ms, start_ms, end_ms, score, confirmed, origins, weight FROM clusters"))
def g16(spark, sf):
    d, p = _get(spark, sf, "peer_detections origin_policy")
    return c.cluster(d, p, SELF)


@query(
    "G17",
    _sql(
        "peer_detections origin_policy",
        _CLUSTER,
        then="""SELECT c.key, c.ad, c.anchor_ms, CAST(count(DISTINCT m.origin) AS BIGINT) AS cells, min(m.confirmed::INT) <> max(m.confirmed::INT) AS disagree,
  EXISTS (SELECT 1 FROM clusters o WHERE o.key = c.key AND o.ad <> c.ad AND o.start_ms < c.end_ms AND c.start_ms < o.end_ms AND o.weight > c.weight) AS contradicted
  FROM clusters c JOIN members m ON m.key = c.key AND m.ad = c.ad AND m.anchor_ms = c.anchor_ms GROUP BY c.key, c.ad, c.anchor_ms, c.start_ms, c.end_ms, c.weight""",
    ),
)
def g17(spark, sf):
    d, p = _get(spark, sf, "peer_detections origin_policy")
    found = c.clustered(c.members(d), p, SELF)
    against = c.contradicted(found).withColumn("contradicted", F.lit(True))
    return found.select("key", "ad", "anchor_ms", F.col("origins").alias("cells"), "disagree").join(against, ["key", "ad", "anchor_ms"], "left").fillna(False, ["contradicted"])


def _page(where: str, order: str, limit: int, offset: int) -> str:
    return _sql("ads pins", then=f"SELECT id, label, type, (SELECT count(*) FROM ads a WHERE {where}) AS total FROM ads a WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}")


def _shown(spark, sf, q):
    return c.page(*_get(spark, sf, "ads pins"), q).select("id", "label", "type", "total")


@query("P1", _page("(contains(lower(label), 'ring') OR false) AND fp_version = 1 AND type = 'ad' AND id NOT IN (SELECT ad FROM pins)", "created DESC, id", 50, 20))
def p1(spark, sf):
    return _shown(spark, sf, c.AdQuery("Ring", 1, "ad", False, False, 50, 20))


@query("W9", _page("true", "lower(label), id", 40, 80))
def w9(spark, sf):
    return _shown(spark, sf, c.AdQuery(by_label=True, limit=40, offset=80))


@query("T3", _page("true", "created DESC, id", 30, 0))
def t3(spark, sf):
    return _shown(spark, sf, c.AdQuery(limit=30))


@query("P2", _sql("ads", then="SELECT id, hex_id FROM ads WHERE starts_with(hex_id, 'c4')"))
def p2(spark, sf):
    return _get(spark, sf, "ads")[0].where(F.col("hex_id").between(*c.id_range("C-4"))).select("id", "hex_id")


@query("P3", _sql("ads", then="SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS found FROM ads WHERE starts_with(hex_id, 'c4c')"))
def p3(spark, sf):
    hits = _get(spark, sf, "ads")[0].where(F.col("hex_id").between(*c.id_range("c4c"))).limit(2).agg(F.count("*").alias("n"))
    return hits.select(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("found"))


for _key, _has in (("J18", True), ("P4", False)):

    @query(_key, _sql("ads pins", then=f"SELECT id FROM ads WHERE id {'IN' if _has else 'NOT IN'} (SELECT ad FROM pins)"))
    def _pinned(spark, sf, has=_has):
        ads, pins = _get(spark, sf, "ads pins")
        return c.filtered(ads, pins, c.AdQuery(pinned=has)).select("id")


@query("J19", _sql("ads origin_policy", then="SELECT id FROM ads a WHERE EXISTS (SELECT 1 FROM origin_policy p WHERE p.origin = a.author AND contains(lower(p.name), '00000001'))"))
def j19(spark, sf):
    ads, p = _get(spark, sf, "ads origin_policy")
    return ads.join(p.where(F.contains(F.lower("name"), F.lit("00000001"))).select(F.col("origin").alias("author")), "author", "left_semi").select("id")


@query("P8", _sql("file_maps", then="SELECT key FROM file_maps WHERE contains(key, '1')"))
def p8(spark, sf):
    return _get(spark, sf, "file_maps")[0].where(F.contains("key", F.lit("1"))).select("key")


@query("J3", _sql("own_detections ads", then="SELECT d.key, d.ad, d.start_ms, coalesce(a.label, '') AS label, coalesce(a.type, 'ad') AS type FROM own_detections d LEFT JOIN ads a ON a.id = d.ad AND a.fp_version = 1"))
def j3(spark, sf):
    d, ads = _get(spark, sf, "own_detections ads")
    named = ads.where("fp_version = 1").select(F.col("id").alias("ad"), "label", "type")
    return d.join(named, "ad", "left").select("key", "ad", "start_ms", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("type", F.lit("ad")).alias("type"))


@query("J4", _sql("peer_detections peer_maps", then="SELECT d.key, d.origin, d.ad, d.start_ms, m.ts FROM peer_detections d JOIN peer_maps m ON m.key = d.key AND m.origin = d.origin"))
def j4(spark, sf):
    d, m = _get(spark, sf, "peer_detections peer_maps")
    return d.join(m, ["key", "origin"]).select("key", "origin", "ad", "start_ms", "ts")


@query("J5", _sql("dups ads", then=f"SELECT d.ad, d.canonical, o.label, c.label AS canonical_label FROM dups d JOIN ads c ON c.id = d.canonical JOIN ads o ON o.id = d.ad WHERE d.origin = {SELF}"))
def j5(spark, sf):
    return c.dup_pairs(*_get(spark, sf, "dups ads"), SELF)


@query("J10", _sql("file_maps file_aliases", then="SELECT asked, arg_min(key, prio) AS key FROM (SELECT key AS asked, key, 0 AS prio FROM file_maps UNION ALL SELECT f.alias, f.key, 1 FROM file_aliases f JOIN file_maps m ON m.key = f.key) WHERE asked LIKE 'a1%' OR asked LIKE 'k%' GROUP BY asked"))
def j10(spark, sf):
    maps, aliases = _get(spark, sf, "file_maps file_aliases")
    asked = maps.select(F.col("key").alias("asked")).unionByName(aliases.select(F.col("alias").alias("asked"))).where("asked LIKE 'a1%' OR asked LIKE 'k%'").distinct()
    return c.resolve(asked, maps, aliases)


@query("J11", _sql("peer_detections file_aliases", then="SELECT * FROM peer_detections d WHERE d.key = 'k7' OR (d.key, d.origin % 90) IN (SELECT key, CAST(substr(alias, 2) AS BIGINT) FROM file_aliases)"))
def j11(spark, sf):
    d, aliases = _get(spark, sf, "peer_detections file_aliases")
    named = aliases.select("key", F.substring("alias", 2, 9).cast("bigint").alias("m"))
    by_alias = d.withColumn("m", F.col("origin") % 90).join(named, ["key", "m"], "left_semi").where("key <> 'k7'").drop("m")
    return d.where("key = 'k7'").unionByName(by_alias)


@query("J16", _sql("ads", then="SELECT id, source_key FROM ads WHERE source_key IN ('k3', 'k12', 'k30')"))
def j16(spark, sf):
    return _get(spark, sf, "ads")[0].where(F.col("source_key").isin("k3", "k12", "k30")).select("id", "source_key")


@query("J21", _sql("peers configured", then="SELECT coalesce(c.name, p.name) AS name, c.url, p.received, c.name IS NOT NULL AS configured, p.name IS NOT NULL AS synced FROM configured c FULL JOIN peers p ON p.name = c.name"))
def j21(spark, sf):
    p, conf = _get(spark, sf, "peers configured")
    both = conf.withColumn("configured", F.lit(True)).join(p.select("name", "received", F.lit(True).alias("synced")), "name", "full")
    return both.select("name", "url", "received", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("synced", F.lit(False)).alias("synced"))


@query("J23", _sql("peer_maps file_maps", then="(SELECT DISTINCT key FROM peer_maps EXCEPT SELECT key FROM file_maps) UNION ALL (SELECT key FROM file_maps EXCEPT SELECT key FROM peer_maps)"))
def j23(spark, sf):
    a, b = (x.select("key").distinct() for x in _get(spark, sf, "peer_maps file_maps"))
    return a.join(b, "key", "left_anti").unionByName(b.join(a, "key", "left_anti"))


@query("G6", _sql("votes_log", _VOTES, then="SELECT ad, count(*) FILTER (value > 0) AS up, count(*) FILTER (value < 0) AS down FROM votes GROUP BY ad"))
def g6(spark, sf):
    return c.votes_by_ad(_voted(spark, sf))


@query("G7", _sql("own_detections peer_detections", then="SELECT ad, count(DISTINCT key) AS files FROM (SELECT ad, key FROM own_detections UNION ALL SELECT ad, key FROM peer_detections) GROUP BY ad"))
def g7(spark, sf):
    return c.files_by_ad(*_get(spark, sf, "own_detections peer_detections"))


@query("G8", _sql("own_detections peer_detections", _CONFIRMING, then="SELECT ad, count(DISTINCT origin) AS confirmations FROM confirming GROUP BY ad"))
def g8(spark, sf):
    return c.confirmations_by_ad(*_get(spark, sf, "own_detections peer_detections"), SELF)


@query("G9", _sql("own_detections file_maps peer_detections peer_maps", then="SELECT ad, max(t) AS last_seen FROM (SELECT d.ad, m.updated AS t FROM own_detections d JOIN file_maps m ON m.key = d.key UNION ALL SELECT d.ad, m.ts FROM peer_detections d JOIN peer_maps m ON m.key = d.key AND m.origin = d.origin) GROUP BY ad"))
def g9(spark, sf):
    return c.last_seen(*_get(spark, sf, "own_detections file_maps peer_detections peer_maps"))


@query("G10", _sql("records", then="SELECT origin, count(*) AS records, max(received) AS last_received FROM records GROUP BY origin"))
def g10(spark, sf):
    return _get(spark, sf, "records")[0].groupBy("origin").agg(F.count("*").alias("records"), F.max("received").alias("last_received"))


_ORIGINS = "origin_policy records votes_log ads dups retractions ad_adds"
_AUTHORS = """gone AS (SELECT DISTINCT l.ad FROM live l JOIN ads a ON a.id = l.ad AND a.author = l.origin),
authors AS (SELECT author AS origin, count(*) AS ads, count(*) FILTER (id IN (SELECT ad FROM trash)) AS trashed, count(*) FILTER (id IN (SELECT ad FROM dup_ads)) AS dups, count(*) FILTER (id IN (SELECT ad FROM gone)) AS retracted FROM ads WHERE author IS NOT NULL GROUP BY 1)"""


def _origins(spark, sf):
    policy, records, _, ads, dups, r, adds = _get(spark, sf, _ORIGINS)
    votes = _voted(spark, sf)
    return c.origins(policy, records, votes, ads, c.trash(votes, policy, SELF), c.called_dups(dups, policy, SELF), c.live_retractions(r, adds), SELF)


@query("G11", _sql(_ORIGINS, _VOTES, _LIVE, _TRASH, _DUPADS, _AUTHORS, then="SELECT origin, ads, trashed, dups, retracted FROM authors"))
def g11(spark, sf):
    return _origins(spark, sf).where("ads > 0").select("origin", "ads", "trashed", "dups", "retracted")


@query(
    "G12",
    _sql(
        _ORIGINS,
        _VOTES,
        _LIVE,
        _TRASH,
        _DUPADS,
        _AUTHORS,
        "every AS (SELECT origin FROM origin_policy UNION SELECT origin FROM records UNION SELECT origin FROM votes UNION SELECT origin FROM authors UNION SELECT 1)",
        then=f"""SELECT e.origin, e.origin = {SELF} AS is_self, coalesce(p.name, '') AS name, round({w("e.origin")}, 9) AS w, coalesce(p.blocked, false) AS blocked, coalesce(p.managed, false) AS managed, r.last_received,
  coalesce(r.n, 0) AS records, coalesce(v.n, 0) AS votes, coalesce(a.ads, 0) AS ads, coalesce(a.trashed, 0) AS trashed, coalesce(a.dups, 0) AS dups, coalesce(a.retracted, 0) AS retracted
  FROM every e LEFT JOIN origin_policy p ON p.origin = e.origin LEFT JOIN (SELECT origin, count(*) AS n, max(received) AS last_received FROM records GROUP BY 1) r ON r.origin = e.origin
  LEFT JOIN (SELECT origin, count(*) AS n FROM votes GROUP BY 1) v ON v.origin = e.origin LEFT JOIN authors a ON a.origin = e.origin""",
    ),
)
def g12(spark, sf):
    return _origins(spark, sf)


@query("T6", _sql("origin_policy records", then=f"SELECT origin, n, row_number() OVER (ORDER BY origin = {SELF} DESC, n DESC, origin) AS place FROM (SELECT origin, count(*) AS n FROM records GROUP BY 1) ORDER BY place LIMIT 25"))
def t6(spark, sf):
    n = _get(spark, sf, "records")[0].groupBy("origin").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc(F.col("origin") == SELF), F.desc("n"), "origin").limit(25)
    # the window ranks at most 25 rows
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("origin") == SELF), F.desc("n"), "origin")).cast("long"))


@query("G14", _sql("records votes_log origin_policy", _VOTES, _TRASH, then="SELECT via, count(*) AS relayed, count(*) FILTER (ad IN (SELECT ad FROM trash)) AS relayed_trash FROM (SELECT DISTINCT via, ad FROM records WHERE kind = 'ad.add' AND via IS NOT NULL) GROUP BY via"))
def g14(spark, sf):
    records, _, policy = _get(spark, sf, "records votes_log origin_policy")
    return c.relayed(records, c.trash(_voted(spark, sf), policy, SELF))


@query("J8", _sql("records", then="SELECT DISTINCT via, ad FROM records WHERE kind = 'ad.add' AND via IS NOT NULL"))
def j8(spark, sf):
    return _get(spark, sf, "records")[0].where("kind = 'ad.add' AND via IS NOT NULL").select("via", "ad").distinct()


_FILES = "file_maps own_detections peer_maps peer_detections"
_REPORT = """report AS (SELECT key, max(own) = 1 AS own, max(t) AS updated, coalesce(nullif(max(own_ms), 0), max(peer_ms)) AS duration_ms, CAST(sum(analyzed_ms) AS BIGINT) AS analyzed_ms, CAST(sum(ads) AS BIGINT) AS ads, CAST(sum(peer_ads) AS BIGINT) AS peer_ads, count(DISTINCT origin) AS origins FROM (
  SELECT key, 1 AS own, updated AS t, duration_ms AS own_ms, NULL AS peer_ms, analyzed_ms, (SELECT count(*) FROM own_detections d WHERE d.key = m.key) AS ads, 0 AS peer_ads, NULL AS origin FROM file_maps m
  UNION ALL SELECT key, 0, ts, NULL, duration_ms, 0, 0, (SELECT count(*) FROM peer_detections d WHERE d.key = m.key AND d.origin = m.origin), origin FROM peer_maps m) GROUP BY key)"""


@query("G15", _sql(_FILES, _REPORT, then="SELECT key, own, updated, duration_ms, analyzed_ms, ads, peer_ads, origins FROM report"))
def g15(spark, sf):
    return c.files_report(*_get(spark, sf, _FILES))


@query("T7", _sql(_FILES, _REPORT, then="SELECT key, updated, origins FROM report ORDER BY updated DESC, key LIMIT 10"))
def t7(spark, sf):
    return c.files_report(*_get(spark, sf, _FILES)).orderBy(F.desc("updated"), "key").limit(10).select("key", "updated", "origins")


@query("G38", _sql("ads", then="SELECT DISTINCT fp_version FROM ads"))
def g38(spark, sf):
    return _get(spark, sf, "ads")[0].select("fp_version").distinct().orderBy("fp_version")


@query("G37", _sql("ads", then="SELECT sha256('index' || string_agg(d, '' ORDER BY part)) AS digest FROM (SELECT substr(hex_id, 1, 2) AS part, sha256(string_agg(hex_id, '' ORDER BY hex_id)) AS d FROM ads WHERE fp_version = 1 AND type = 'intro' GROUP BY 1)"))
def g37(spark, sf):
    return c.digest(_get(spark, sf, "ads")[0].where("fp_version = 1 AND type = 'intro'"), "hex_id", "index")


@query("G39", _sql("ad_points", then="SELECT count(*) FILTER (ad % 5 = 0) > greatest(65536, count(*) // 16) OR count(*) FILTER (ad % 7 = 3) > greatest(65536, count(*) // 8) AS rebuild FROM ad_points"))
def g39(spark, sf):
    p = _get(spark, sf, "ad_points")[0]
    sums = p.agg(F.count_if(F.col("ad") % 5 == 0).alias("overlay"), F.count_if(F.col("ad") % 7 == 3).alias("dead"), F.count("*").alias("n"))
    over = lambda col, part: F.col(col) > F.greatest(F.lit(65536), F.floor(F.col("n") / part))
    return sums.select((over("overlay", 16) | over("dead", 8)).alias("rebuild"))


@query("U1", _sql("own_detections peer_detections", then="SELECT key, ad, start_ms, CAST(NULL AS BIGINT) AS origin FROM own_detections UNION ALL SELECT key, ad, start_ms, origin FROM peer_detections"))
def u1(spark, sf):
    own, peer = _get(spark, sf, "own_detections peer_detections")
    return own.select("key", "ad", "start_ms", F.lit(None).cast("long").alias("origin")).unionByName(peer.select("key", "ad", "start_ms", "origin"))


@query("U4", _sql("peers origin_policy", then="SELECT origin, arg_max(name, prio) AS name FROM (SELECT node_id AS origin, name, 0 AS prio FROM peers UNION ALL SELECT origin, name, 1 FROM origin_policy WHERE name <> '') GROUP BY origin"))
def u4(spark, sf):
    return c.names(*_get(spark, sf, "peers origin_policy"))


@query("U5", _sql("ads pins", then="SELECT id, 'add' AS change FROM (SELECT id FROM ads WHERE type = 'intro' EXCEPT SELECT ad FROM pins) UNION ALL SELECT ad, 'drop' FROM (SELECT ad FROM pins EXCEPT SELECT id FROM ads WHERE type = 'intro')"))
def u5(spark, sf):
    ads, pins = _get(spark, sf, "ads pins")
    want, held = ads.where("type = 'intro'").select("id"), pins.select(F.col("ad").alias("id"))
    return want.exceptAll(held).withColumn("change", F.lit("add")).unionByName(held.exceptAll(want).withColumn("change", F.lit("drop")))


@query("X1", _sql("ads", then="SELECT id, label FROM ads WHERE id IN (3, 5, 8, 13, 21, 99999999)"))
def x1(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 99999999)], "id long")
    return _get(spark, sf, "ads")[0].join(F.broadcast(ids), "id", "left_semi").select("id", "label")


_BUNDLE = f"""SELECT 'vote' AS part, v.ad, v.origin, CAST(v.value AS VARCHAR) AS said, {w('v.origin')} AS w, v.ts FROM votes v LEFT JOIN origin_policy p ON p.origin = v.origin
UNION ALL SELECT 'label', ad, origin, label, NULL, ts FROM (SELECT * FROM labels_log QUALIFY row_number() OVER (PARTITION BY ad, origin ORDER BY ts DESC, seq DESC) = 1)
UNION ALL SELECT 'dup', ad, origin, CAST(canonical AS VARCHAR), NULL, NULL FROM dups
UNION ALL SELECT 'sighting', ad, NULL, key, NULL, start_ms FROM own_detections UNION ALL SELECT 'sighting', ad, origin, key, NULL, start_ms FROM peer_detections
UNION ALL SELECT 'history', ad, origin, kind, NULL, ts FROM (SELECT * FROM records WHERE kind <> 'file.map' QUALIFY row_number() OVER (PARTITION BY ad ORDER BY id DESC) <= 200)"""


@query("X2", _sql("votes_log origin_policy own_detections peer_detections labels_log dups records", _VOTES, then=_BUNDLE))
def x2(spark, sf):
    """What the detail of each ad shows: votes with their weights, labels, duplicate claims, sightings, and the newest 200 records."""
    from pyspark.sql import Window

    _, policy, own, peer, labels, dups, records = _get(spark, sf, "votes_log origin_policy own_detections peer_detections labels_log dups records")
    none = F.lit(None)
    part = lambda name, df, said, origin=F.col("origin"), weight=none.cast("double"), ts=none: df.select(F.lit(name).alias("part"), "ad", origin.cast("long").alias("origin"), said.cast("string").alias("said"), weight.cast("double").alias("w"), ts.cast("long").alias("ts"))
    newest = F.row_number().over(Window.partitionBy("ad").orderBy(F.desc("id")))
    history = records.where("kind <> 'file.map'").withColumn("n", newest).where("n <= 200")
    out = part("vote", c.weighed(_voted(spark, sf), policy, SELF), F.col("value"), weight=F.col("w"), ts=F.col("ts"))
    out = out.unionByName(part("label", c.latest(labels, "ad", "origin"), F.col("label"), ts=F.col("ts"))).unionByName(part("dup", dups, F.col("canonical")))
    out = out.unionByName(part("sighting", own, F.col("key"), none, ts=F.col("start_ms"))).unionByName(part("sighting", peer, F.col("key"), ts=F.col("start_ms")))
    return out.unionByName(part("history", history, F.col("kind"), ts=F.col("ts")))


@query("X17", _sql("peers records votes_log origin_policy", _VOTES, _TRASH, then="SELECT p.name, p.received, coalesce(r.n, 0) AS relayed FROM peers p LEFT JOIN (SELECT via, count(*) AS n FROM (SELECT DISTINCT via, ad FROM records WHERE kind = 'ad.add' AND via IS NOT NULL) GROUP BY via) r ON r.via = p.node_id"))
def x17(spark, sf):
    peers, records, _, policy = _get(spark, sf, "peers records votes_log origin_policy")
    rel = c.relayed(records, c.trash(_voted(spark, sf), policy, SELF))
    return peers.join(rel, peers.node_id == rel.via, "left").select("name", "received", F.coalesce("relayed", F.lit(0)).alias("relayed"))


@query("S1", _sql("ads", then="SELECT id, label, type, created FROM ads WHERE type = 'intro'"))
def s1(spark, sf):
    return _get(spark, sf, "ads")[0].where("type = 'intro'").select("id", "label", "type", "created")


@query("S2", _sql("ads", then="SELECT id, label FROM ads WHERE fp_version = 1"))
def s2(spark, sf):
    return _get(spark, sf, "ads")[0].where("fp_version = 1").select("id", "label").orderBy("id")


@query("S3", _sql("ad_points pins", then="SELECT ad, h, t FROM ad_points WHERE ad IN (SELECT ad FROM pins)"))
def s3(spark, sf):
    points, pins = _get(spark, sf, "ad_points pins")
    return points.join(pins, "ad", "left_semi")


@query("S4", _sql("ads", then="SELECT id, n_points FROM ads WHERE id = 11"))
def s4(spark, sf):
    return _get(spark, sf, "ads")[0].where("id = 11").select("id", "n_points")


@query("P19", _sql("ads", then="SELECT id FROM ads WHERE n_points >= 50 AND duration_ms <= 524000 AND duration_ms BETWEEN 3000 AND 180000"))
def p19(spark, sf):
    return _get(spark, sf, "ads")[0].where((F.col("n_points") >= 50) & (F.col("duration_ms") <= 524_000) & F.col("duration_ms").between(3000, 180_000)).select("id")


@query("T5", _sql("ads", then="SELECT id, row_number() OVER (ORDER BY created, id) AS place FROM ads ORDER BY place LIMIT 100"))
def t5(spark, sf):
    from pyspark.sql import Window

    top = _get(spark, sf, "ads")[0].orderBy("created", "id").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy("created", "id")).cast("long").alias("place"))
