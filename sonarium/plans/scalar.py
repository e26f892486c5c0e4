"""Queries of scalar functions, sources and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, fingerprint, keys, media
from ..operators import metrics
from ..sources import records as record_source
from .fixtures import spread, tables, with_

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str | None = None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


@query("F1", "SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey % 512) << 15) | ((l_suppkey % 512) << 6) | (l_linenumber % 64) AS h, l_suppkey % 512 AS f2 FROM lineitem")
def f1(spark, sf):
    x = tables(spark, sf, "lineitem")[0]
    h = fingerprint.pack((F.col("l_partkey") % 512).cast("long"), (F.col("l_suppkey") % 512).cast("long"), (F.col("l_linenumber") % 64).cast("long"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", h.alias("h")).withColumn("f2", fingerprint.unpack(F.col("h"))["f2"])


@query("F4", "SELECT p_partkey AS id, lower(substr(sha256(unhex('01000000' || md5(CAST(p_partkey AS VARCHAR)))), 1, 32)) AS content_id FROM part")
def f4(spark, sf):
    blob = F.unhex(F.md5(F.col("p_partkey").cast("string")))
    return tables(spark, sf, "part")[0].select(F.col("p_partkey").alias("id"), F.lower(F.hex(codec.content_id(blob))).alias("content_id"))


@query("F5", "SELECT c_custkey, sha256(encode('record v1') || '\\x00'::BLOB || encode(c_mktsegment) || '\\x00'::BLOB || encode(c_name)) AS digest FROM customer")
def f5(spark, sf):
    signed = F.concat(F.lit(bytearray(codec.DOMAIN)), F.encode("c_mktsegment", "UTF-8"), F.lit(bytearray(1)), F.encode("c_name", "UTF-8"))
    return tables(spark, sf, "customer")[0].select("c_custkey", F.sha2(signed, 256).alias("digest"))


@query("F6", "SELECT c_custkey, lower(sha256(c_name)) AS origin, substr(lower(sha256(c_name)), 1, 8) AS short FROM customer")
def f6(spark, sf):
    o = F.lower(F.hex(F.unhex(F.sha2("c_name", 256))))
    return tables(spark, sf, "customer")[0].select("c_custkey", o.alias("origin"), F.substring(o, 1, 8).alias("short"))


@query("F7", "SELECT event_id, CAST((CAST(event_id * 7919 + 1 AS HUGEINT) * 1001 * 1000000000 * 2 + 90000) // (2 * 90000) AS BIGINT) AS ns FROM events")
def f7(spark, sf):
    return tables(spark, sf, "events")[0].select("event_id", media.ticks(F.col("event_id") * 7919 + 1, F.lit(1001), F.lit(90000)).alias("ns"))


@query("F8", "SELECT event_id, CAST((event_id * 1234567 + 500000) // 1000000 AS INTEGER) AS ms, (event_id * 1234567 * 8000 + 500000000) // 1000000000 AS samples FROM events")
def f8(spark, sf):
    ns = F.col("event_id") * 1234567
    return tables(spark, sf, "events")[0].select("event_id", media.to_ms(ns).alias("ms"), media.sample_count(ns).alias("samples"))


_CONTENT = "SELECT doc_id, 'c:' || sha256(unhex(array_to_string(list_transform(range(0, 8), lambda i: printf('%02X', (octet_length(b) >> CAST(8 * i AS INTEGER)) & 255)), '')) || CASE WHEN octet_length(b) <= 131072 THEN b[1:65536] || b[greatest(1, octet_length(b) - 65535):] ELSE b[1:65536] || b[octet_length(b) - 65535:] END) AS key FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)"


def content_keys(df, row: str, text: str):
    """Content keys of whole texts: their size, first and last 64 KiB (which overlap or are equal in short ones)."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw).cast("long")
    tail = F.substr(raw, F.greatest(F.lit(1), F.octet_length(raw) - keys.EDGE + 1), F.lit(keys.EDGE))
    return df.select(row, keys.content(size, F.substr(raw, F.lit(1), F.lit(keys.EDGE)), tail).alias("key"))


@query("F9", _CONTENT)
def f9(spark, sf):
    return content_keys(tables(spark, sf, "documents")[0], "doc_id", "text")


@query("F10", "SELECT c_custkey, 'id:' || substr(sha256(c_name), 1, 32) AS key FROM customer")
def f10(spark, sf):
    return tables(spark, sf, "customer")[0].select("c_custkey", keys.opaque(F.col("c_name")).alias("key"))


@query("P16", "SELECT c_custkey, c_custkey % 3 <> 2 AS storable FROM customer")
def p16(spark, sf):
    key = F.element_at(F.array(F.lit("ih:x"), F.lit("c:y"), F.lit("http://z")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return tables(spark, sf, "customer")[0].select("c_custkey", keys.storable(key).alias("storable"))


@query("F11", "SELECT c_custkey, 'ih:' || substr(sha256(c_name), 1, 40) || '/' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '7' END AS key FROM customer")
def f11(spark, sf):
    """Infohashes in upper-case hex and in base32 name the same key."""
    rows = spread(tables(spark, sf, "customer")[0].select("c_custkey", "c_name")).select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 40).alias("h"))
    h = F.col("h")
    given = F.when(F.col("c_custkey") % 3 == 0, F.upper(h)).when(F.col("c_custkey") % 3 == 1, F.lower(keys.base32(h))).otherwise(keys.base32(h))
    return rows.select("c_custkey", keys.torrent(given, F.when(F.col("c_custkey") % 2 == 0, "").otherwise("7")).alias("key"))


@query("F12", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (2, 4) THEN '' ELSE 'ih:' || substr(sha256(c_name), 1, 40) || '/3' END AS key FROM customer")
def f12(spark, sf):
    rows = spread(tables(spark, sf, "customer")[0].select("c_custkey", "c_name")).select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 40).alias("h"))
    h = F.col("h")
    shapes = [("http://t.example/a/play/", h, "/3"), ("http://t.example/stream/x.mkv?index=3&link=magnet%3A%3Fxt%3Durn%3Abtih%3A", keys.base32(h), "%26dn%3Dx"), ("http://t.example/stream?link=", h, ""), ("http://t.example/stream?index=3&link=", keys.base32(h), ""), ("http://t.example/video?index=3&link=", h, "")]
    url = F.coalesce(*(F.when(F.col("c_custkey") % 5 == k, F.concat(F.lit(a), x, F.lit(z))) for k, (a, x, z) in enumerate(shapes)))
    return rows.select("c_custkey", keys.stream_key(url).alias("key"))


_SPLIT = r"""parts AS (SELECT page_id, url, regexp_extract(url, '^([^:]+)://', 1) AS scheme, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM cleaned),
cut AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '') AS ps FROM parts)"""
_CLEANED = "cleaned AS (SELECT page_id, CASE WHEN contains(url, '#') THEN regexp_replace(url, '#[^?]*', '') || '#x' ELSE url END AS url FROM urls)"


def _urls(spark, sf):
    u = tables(spark, sf, "urls")[0]
    return u.withColumn("url", F.when(F.contains("url", F.lit("#")), F.concat(F.regexp_replace("url", "#[^?]*", ""), F.lit("#x"))).otherwise(F.col("url")))


@query("F13", with_("urls") + ", " + _CLEANED + ", " + _SPLIT + r""", kept AS (SELECT *, list_sort(list_filter(ps, lambda p: lower(string_split(p, '=')[1]) NOT IN ('token', 'expires'))) AS k FROM cut)
SELECT page_id, scheme || '://' || lower(host) || path || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(list_transform(k, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') END AS url FROM kept""")
def f13(spark, sf):
    return _urls(spark, sf).select("page_id", keys.normalised_url(F.col("url")).alias("url"))


@query("F14", with_("urls") + ", " + _CLEANED + ", " + _SPLIT + r""", kept AS (SELECT *, list_sort(list_transform(ps, lambda p: CASE WHEN lower(string_split(p, '=')[1]) IN ('token', 'expires') THEN string_split(p, '=')[1] || '=REDACTED' WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS k FROM cut)
SELECT page_id, scheme || '://' || host || path || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(k, '&') END || CASE WHEN fragment = '' THEN '' ELSE '#' || fragment END AS url FROM kept""")
def f14(spark, sf):
    return _urls(spark, sf).select("page_id", keys.redacted_url(F.col("url")).alias("url"))


@query("F16", "SELECT event_id, CASE WHEN ms // 3600000 > 0 THEN printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%d:%02d', ms // 60000 % 60, ms // 1000 % 60) END AS shown FROM (SELECT event_id, event_id * 977 AS ms FROM events)")
def f16(spark, sf):
    return tables(spark, sf, "events")[0].select("event_id", media.position(F.col("event_id") * 977).alias("shown"))


@query("F17", with_("ads") + "SELECT id, CASE WHEN id % 4 = 0 THEN type || '-' || substr(hex_id, 1, 8) ELSE label END AS label FROM ads")
def f17(spark, sf):
    x = tables(spark, sf, "ads")[0].withColumn("label", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("label")))
    return x.select("id", media.label_or_default(F.col("label"), F.col("type"), F.col("hex_id")).alias("label"))


@query("F19", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 11 END AS total FROM orders")
def f19(spark, sf):
    total = F.when(F.col("o_orderkey") % 5 == 0, F.lit("*")).otherwise((F.col("o_orderkey") * 11).cast("string"))
    return tables(spark, sf, "orders")[0].select("o_orderkey", media.total_size(F.concat(F.lit("bytes 0-9/"), total)).alias("total"))


@query("F20", with_("reports") + "SELECT id, 'play --start=' || CAST(greatest(0, pos_ms // 1000 - 20) AS VARCHAR) || ' ' || norm AS command FROM reports")
def f20(spark, sf):
    start = F.greatest(F.lit(0), F.floor(F.col("pos_ms") / 1000) - 20)
    return tables(spark, sf, "reports")[0].select("id", F.concat(F.lit("play --start="), start.cast("string"), F.lit(" "), F.col("norm")).alias("command"))


@query("F21", with_("records") + "SELECT id, max(ts - n) OVER (PARTITION BY origin ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS clock FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq DESC) AS n FROM records)")
def f21(spark, sf):
    """Clock readings for wall times in a given order: each at least the wall time and past the reading before."""
    w = Window.partitionBy("origin").orderBy("n")
    n = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("seq")))
    rows = tables(spark, sf, "records")[0].withColumn("n", n.cast("long"))
    return rows.select("id", (F.max(F.col("ts") - F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n")).alias("clock"))


@query("F23", "SELECT o_orderkey, CASE WHEN o_orderkey % 700 BETWEEN 100 AND 599 THEN CAST(o_orderkey % 700 // 100 AS VARCHAR) || 'xx' ELSE 'other' END AS class FROM orders")
def f23(spark, sf):
    return tables(spark, sf, "orders")[0].select("o_orderkey", metrics.status_class(F.col("o_orderkey") % 700).alias("class"))


@query("K22", with_("own_detections") + "SELECT key, ad, start_ms, '{\"start\":' || start_ms || ',\"end\":' || end_ms || ',\"score\":' || score || '}' AS json FROM own_detections")
def k22(spark, sf):
    return tables(spark, sf, "own_detections")[0].select("key", "ad", "start_ms", F.to_json(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "score")).alias("json"))


@query("S14", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'matroska' WHEN 1 THEN 'avi' WHEN 2 THEN 'mp4' WHEN 3 THEN 'mp3' ELSE '' END AS container FROM customer")
def s14(spark, sf):
    heads = [b"\x1a\x45\xdf\xa3" + bytes(20), b"RIFF\0\0\0\0AVI " + bytes(8), b"\0\0\0\x20ftypisom" + bytes(8), b"ID3" + bytes(20), b"nothing at all known"]
    head = F.get(F.array(*(F.lit(bytearray(h)) for h in heads)), (F.col("c_custkey") % 5).cast("int"))
    return tables(spark, sf, "customer")[0].select("c_custkey", media.container(head).alias("container"))


BOUNDS = metrics.exponential_bounds(10.0, 2.0, 8)


@query("G24", with_("observations") + "SELECT family, le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM observations, (SELECT unnest([10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0, 1280.0, NULL])::DOUBLE AS le) b GROUP BY ALL")
def g24(spark, sf):
    return metrics.histogram(tables(spark, sf, "observations")[0], BOUNDS, "family")


@query("G25", "SELECT CAST(i AS BIGINT) AS i, 10.0::DOUBLE * pow(2.0, i) AS bound FROM range(0, 8) r(i)")
def g25(spark, sf):
    return spark.createDataFrame(list(enumerate(BOUNDS)), "i long, bound double")


@query("G26", with_("observations") + "SELECT family, sum(greatest(value - 30, 0)) AS value FROM observations GROUP BY family")
def g26(spark, sf):
    return metrics.counter(tables(spark, sf, "observations")[0].withColumn("value", F.col("value") - 30), "family").withColumn("value", F.round("value", 6).cast("double"))


ORACLE["G26"] = with_("observations") + "SELECT family, round(sum(greatest(value - 30, 0)), 6) AS value FROM observations GROUP BY family"


@query("G27", with_("observations") + ", s AS (SELECT floor(value / 5) * 5 AS low, floor(value / 5) * 5 + 5 AS high, count(*) AS n FROM observations GROUP BY ALL) SELECT (SELECT min(le) FROM (SELECT unnest([10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0, 1280.0])::DOUBLE AS le) WHERE le >= high) AS le, CAST(sum(n) AS BIGINT) AS n, CAST(sum((low + high) / 2 * n) AS DOUBLE) AS sum FROM s GROUP BY 1")
def g27(spark, sf):
    low = (F.floor(F.col("value") / 5) * 5).cast("double")
    s = tables(spark, sf, "observations")[0].groupBy(low.alias("low")).agg(F.count("*").alias("n")).withColumn("high", F.col("low") + 5)
    return metrics.rebucketed(s, BOUNDS)


@query("K21", "SELECT 'events_total' AS name, '# TYPE events_total counter' || chr(10) || string_agg('events_total{type=\"' || event_type || '\"} ' || n, chr(10) ORDER BY event_type) AS text FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def k21(spark, sf):
    n = tables(spark, sf, "events")[0].groupBy(F.col("event_type").alias("label_value")).agg(F.count("*").cast("double").alias("value"))
    return metrics.exposition(n.select(F.lit("events_total").alias("name"), F.lit("counter").alias("kind"), F.lit("type").alias("label"), "label_value", "value"))


def _pcm(spark, sf):
    """Signals: the vectors of each label one after another, repeated to two seconds at least."""
    e = tables(spark, sf, "embeddings")[0]
    one = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    flat = F.flatten(F.transform("v", lambda x: x["embedding"]))
    return one.select(F.col("label").cast("long").alias("ad"), F.flatten(F.array_repeat(flat, 20)).alias("pcm"))


@query("F2")
def f2(spark, sf):
    return fingerprint.fingerprinted(_pcm(spark, sf), "ad")


@query("W4")
def w4(spark, sf):
    found = fingerprint.fingerprinted(_pcm(spark, sf), "ad")
    return found.groupBy("ad", "t").agg(F.count("*").alias("pairs"))


@query("F3")
def f3(spark, sf):
    """Landmarks encoded and decoded again: those that come back equal."""
    found = fingerprint.fingerprinted(_pcm(spark, sf), "ad")

    def check(batches):
        for batch in batches:
            points = sorted(zip(batch["h"].tolist(), batch["t"].tolist(), strict=True), key=lambda p: (p[1], p[0]))
            blob = codec.encode(points)
            batch["bytes"] = len(blob)
            batch["equal"] = codec.decode(blob) == points
            yield batch[["ad", "h", "t", "bytes", "equal"]]

    return found.mapInPandas(check, "ad long, h long, t long, bytes long, equal boolean")


@query("S10")
def s10(spark, sf):
    """Records written as frames and read again through the reader of binary files."""
    return record_source.round_trip(tables(spark, sf, "records")[0])


@query("S13", """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 4), lambda i: CAST('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) AS INTEGER))) AS x FROM d)
SELECT d.doc_id, length(h) // 4 AS n, coalesce(top, 0.0) AS top FROM d LEFT JOIN (SELECT doc_id, max(abs(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END)) / 32768.0 AS top FROM s GROUP BY doc_id) m ON m.doc_id = d.doc_id""")
def s13(spark, sf):
    """Whole texts as 16-bit samples: how many, and the loudest."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")

    def run(batches):
        for batch in batches:
            batch["n"] = [len(fingerprint.samples(bytes(x))) for x in batch["raw"]]
            batch["top"] = [float(np.abs(fingerprint.samples(bytes(x))).max(initial=0)) for x in batch["raw"]]
            yield batch[["doc_id", "n", "top"]]

    return tables(spark, sf, "documents")[0].select("doc_id", raw.alias("raw")).mapInPandas(run, "doc_id long, n long, top double")
