"""Queries of record bodies, of all kinds, and of routes to sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import bodies, codec
from .fixtures import table, tables, with_

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str):
    def keep(f):
        QUERIES[key], ORACLE[key] = f, sql
        return f

    return keep


#: Landmarks of ads: enough, too few, and none at all.
BLOBS = [codec.encode([(7 * i, i // 6) for i in range(60)]), codec.encode([(7 * i, i // 6) for i in range(40)]), b"\1\0"]
IDS = [hashlib.sha256(b"\1\0\0\0" + b).digest()[:16].hex() for b in BLOBS]
ZERO = "0" * 32


def _bodies(spark, sf):
    """(id, kind, json): a body for each record, some with faults."""
    r, n = table(spark, sf, "log6"), F.col("id")
    is_ = lambda kind: F.col("kind") == kind
    of = lambda kind, x: F.when(is_(kind), x)
    ad = F.when(n % 13 == 0, ZERO).otherwise(F.md5(F.col("ad").cast("string")))
    at = F.when(n % 41 == 0, 2).when(n % 37 == 0, 1).otherwise(0)
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), at)
    key = F.concat(F.when(n % 17 == 0, "x:").otherwise("c:"), "key")
    fields = {
        "id": of("ad.add", F.when(n % 13 == 0, IDS[1]).otherwise(pick(IDS))),
        "fp_version": F.when(is_("ad.add") | is_("file.map"), F.when(n % 23 == 0, 0).otherwise(1)),
        "duration_ms": F.when(is_("ad.add") | is_("file.map"), n % 29 * 25_000),
        "points": of("ad.add", F.base64(pick([bytearray(b) for b in BLOBS]))),
        "label": F.when(is_("ad.add") | is_("ad.label"), F.when(n % 19 == 0, F.repeat(F.lit("é"), 201)).otherwise(F.col("label"))),
        "type": F.when(is_("ad.add") | is_("ad.label"), F.when(n % 31 == 0, "song").otherwise("intro")),
        "ad": F.when(F.col("kind").startswith("ad.") & ~is_("ad.add"), ad),
        "value": of("ad.vote", F.when(n % 19 == 0, 0).otherwise(F.col("value"))),
        "reason": of("ad.vote", F.lit("boundary")),
        "key": F.when(is_("ad.vote") | is_("file.map"), key),
        "canonical": of("ad.dup", F.md5(F.col("canonical").cast("string"))),
        "analyzed": of("file.map", F.array(F.array(n, n + n % 7))),
    }
    cast = {f.name: f.dataType for f in spark.createDataFrame([], bodies.SCHEMA).schema}
    return r.select("id", "kind", "ad", F.to_json(F.struct(*(x.cast(cast[c]).alias(c) for c, x in fields.items()))).alias("json"))


_AD = "CASE WHEN id % 13 = 0 THEN '" + ZERO + "' ELSE md5(CAST(ad AS VARCHAR)) END"
_LABEL = "CASE WHEN id % 19 = 0 THEN repeat('é', 201) ELSE label END"
_KEY = "CASE WHEN id % 17 = 0 THEN 'x:' ELSE 'c:' END || key"


@query("P15", with_("records", "log6") + """SELECT id, CASE
  WHEN kind = 'ad.add' THEN CASE WHEN id % 23 = 0 THEN 'version' WHEN id % 29 * 25000 NOT BETWEEN 1 AND 600000 THEN 'duration' WHEN id % 41 = 0 OR id % 37 = 0 THEN 'landmarks' WHEN id % 13 = 0 THEN 'hash' WHEN id % 19 = 0 THEN 'label' WHEN id % 31 = 0 THEN 'type' END
  WHEN kind = 'ad.label' THEN CASE WHEN id % 13 = 0 THEN 'ad' WHEN id % 31 = 0 THEN 'type' WHEN id % 19 = 0 THEN 'label' END
  WHEN kind = 'ad.vote' THEN CASE WHEN id % 13 = 0 THEN 'ad' WHEN id % 19 = 0 THEN 'value' WHEN id % 17 = 0 THEN 'key' END
  WHEN kind = 'ad.dup' THEN CASE WHEN id % 13 = 0 OR ad = canonical THEN 'ad' END
  WHEN kind = 'ad.retract' THEN CASE WHEN id % 13 = 0 THEN 'ad' END
  WHEN kind = 'file.map' THEN CASE WHEN id % 17 = 0 THEN 'key' WHEN id % 23 = 0 THEN 'version' WHEN id % 7 = 0 THEN 'range' END END AS reason FROM log6""")
def p15(spark, sf):
    """What is wrong with the body of each record."""
    rows = _bodies(spark, sf).withColumn("b", bodies.decoded(F.col("json")))
    return rows.select("id", bodies.fault(F.col("kind"), F.col("b")).alias("reason"))


@query("F24", with_("records", "log6") + f"""SELECT id, kind, CASE WHEN kind LIKE 'ad.%' AND kind <> 'ad.add' THEN {_AD} END AS ad, CASE WHEN kind IN ('ad.add', 'ad.label') THEN {_LABEL} END AS label,
  CASE WHEN kind = 'ad.dup' THEN md5(CAST(canonical AS VARCHAR)) END AS canonical, CASE WHEN kind = 'ad.vote' THEN CASE WHEN id % 19 = 0 THEN 0 ELSE value END END AS value,
  CASE WHEN kind IN ('ad.vote', 'file.map') THEN {_KEY} END AS key, CASE WHEN kind = 'file.map' THEN id + id % 7 END AS until FROM log6""")
def f24(spark, sf):
    """Bodies of all kinds through JSON."""
    rows = _bodies(spark, sf).select("id", "kind", bodies.decoded(F.col("json")).alias("b"))
    return rows.select("id", "kind", "b.ad", "b.label", "b.canonical", "b.value", "b.key", F.get(F.get("b.analyzed", F.lit(0)), F.lit(1)).alias("until"))


@query("F18", with_("records", "log6") + f"""SELECT id, CASE kind WHEN 'ad.add' THEN printf('%.1f s, fp v%d', id % 29 * 25000 / 1000.0, CASE WHEN id % 23 = 0 THEN 0 ELSE 1 END) || ', "' || {_LABEL} || '"'
  WHEN 'ad.label' THEN '"' || {_LABEL} || '"' WHEN 'ad.vote' THEN CASE WHEN id % 19 = 0 THEN '+0' WHEN value > 0 THEN '+1' ELSE '-1' END || ' boundary @ ' || {_KEY}
  WHEN 'ad.dup' THEN CASE WHEN id % 13 = 0 THEN '← {ZERO}' ELSE '→ ' || md5(CAST(canonical AS VARCHAR)) END ELSE '' END AS summary FROM log6""")
def f18(spark, sf):
    """What each record says about its ad."""
    rows = _bodies(spark, sf).withColumn("b", bodies.decoded(F.col("json")))
    return rows.select("id", bodies.summary(F.col("kind"), F.col("b"), F.md5(F.col("ad").cast("string"))).alias("summary"))


#: Routes: scheme, host and path of what is asked, and what stands for them; hosts that may be asked otherwise.
ROUTES = [("https", "h0.example", "/", "http://127.0.0.1:8090/in"), ("https", "h1.example", "/en", "http://inner.example")]
ALLOWED = ("h2.example",)
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(.*)$"


def routed(url, routes=ROUTES, allowed=ALLOWED):
    """(target, allowed): the URL by the first route whose scheme, host and path lead to it; other hosts only if they are named."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, host, path, rest = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    target, hit = F.lit(None).cast("string"), F.lit(False)
    for s, h, p, to in reversed(routes):
        p = p.rstrip("/")
        fits = (scheme == s) & (host == h) & ((path == p) | path.startswith(p + "/"))
        target = F.when(fits, F.concat(F.lit(to.rstrip("/")), F.substr(path, F.lit(len(p) + 1)), rest)).otherwise(target)
        hit = fits | hit
    return F.struct(F.coalesce(target, url).alias("target"), (hit | host.isin(*allowed)).alias("allowed"))


@query("P20", """WITH u AS (SELECT page_id, 'H' || page_id % 4 || '.example' AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM pages),
r AS (SELECT *, CASE WHEN host = 'H0.example' AND (path = '' OR path[1] IN ('/', '?', '#')) THEN 'http://127.0.0.1:8090/in' || path
  WHEN host = 'H1.example' AND regexp_matches(path, '^/en([/?#]|$)') THEN 'http://inner.example' || path[4:] END AS target FROM u)
SELECT page_id, coalesce(target, 'https://' || host || path) AS target, target IS NOT NULL OR host = 'H2.example' AS allowed FROM r""")
def p20(spark, sf):
    """Where each page, moved to one of four hosts, is fetched from, and whether it may be."""
    host = F.concat(F.lit("https://H"), (F.col("page_id") % 4).cast("string"), F.lit(".example"))
    url = F.concat(host, F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""))
    return tables(spark, sf, "pages")[0].select("page_id", routed(url).alias("r")).select("page_id", "r.*")
