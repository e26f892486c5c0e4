"""Queries of commands, settings, sessions and views."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fingerprint
from ..operators import catalogue as c
from ..operators import detect, ingest
from ..operators import intervals as iv
from ..operators import match as m
from ..operators.ordered import folded
from . import catalogue, ingest as log_plans, intervals as interval_plans, match as match_plans, scalar
from .fixtures import SELF, tables, with_
from .streams import _folder

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str | None = None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


@query("S5", "SELECT (SELECT count(*) FROM part) AS ads, (SELECT count(*) FROM supplier) AS origins, (SELECT max(p_partkey) FROM part) AS newest")
def s5(spark, sf):
    ads, policy = tables(spark, sf, "ads", "origin_policy")
    # one row each, of one set of files
    return ads.agg(F.count("*").alias("ads"), F.max("id").alias("newest")).join(F.broadcast(policy.agg(F.count("*").alias("origins"))))


MAX_ENTRIES = 500


@query("S11", with_("records", "batch") + f"""SELECT origin, entries, least(coalesce(bad - 1, entries), {MAX_ENTRIES}) AS accepted, CASE WHEN bad <= {MAX_ENTRIES} THEN 'order' WHEN entries > {MAX_ENTRIES} THEN 'entries' ELSE '' END AS error FROM (
  SELECT origin, count(*) AS entries, min(n) FILTER (seq <= p) AS bad FROM (SELECT origin, seq, lag(seq) OVER w AS p, row_number() OVER w AS n FROM batch WINDOW w AS (PARTITION BY origin ORDER BY arrival)) GROUP BY origin)""")
def s11(spark, sf):
    """Bodies of entries, one of each origin, as a reader takes them: up to the first number that does not rise, or the most entries of a body; and what was wrong."""
    w = Window.partitionBy("origin").orderBy("arrival")
    rows = tables(spark, sf, "batch")[0].select("origin", "seq", F.lag("seq").over(w).alias("p"), F.row_number().over(w).cast("long").alias("n"))
    read = rows.groupBy("origin").agg(F.count("*").alias("entries"), F.min(F.when(F.col("seq") <= F.col("p"), F.col("n"))).alias("bad"))
    error = F.when(F.col("bad") <= MAX_ENTRIES, "order").when(F.col("entries") > MAX_ENTRIES, "entries").otherwise("")
    return read.select("origin", "entries", F.least(F.coalesce(F.col("bad") - 1, F.col("entries")), F.lit(MAX_ENTRIES)).alias("accepted"), error.alias("error"))


@query("S19", with_("truth") + "SELECT file, ad, start_ms, end_ms, verified FROM truth WHERE end_ms > start_ms")
def s19(spark, sf):
    """Labels through their JSON form: a document for each file, with its occurrences."""
    entry = F.struct("ad", F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "verified")
    texts = tables(spark, sf, "truth")[0].groupBy("file").agg(F.to_json(F.struct(F.collect_list(entry).alias("ads"))).alias("json"))
    ads = F.from_json("json", "ads array<struct<ad:bigint,startMs:bigint,endMs:bigint,verified:boolean>>")["ads"]
    return texts.select("file", F.inline(ads)).where("endMs > startMs").select("file", "ad", F.col("startMs").alias("start_ms"), F.col("endMs").alias("end_ms"), "verified")


def _digests(points):
    rows = F.sort_array(F.collect_list(F.struct("h", "t")))
    text = F.array_join(F.transform("r", lambda e: F.concat_ws(":", e["h"].cast("string"), e["t"].cast("string"))), ",")
    return points.groupBy("ad").agg(rows.alias("r")).select("ad", F.sha2(text, 256).alias("digest"))


@query("S21", with_("ad_points") + "SELECT ad, sha256(string_agg(h || ':' || t, ',' ORDER BY h, t)) AS digest, ad % 7 <> 3 AS valid FROM ad_points GROUP BY ad")
def s21(spark, sf):
    """An index written with the digest of each ad, opened and checked; the postings of some ads are damaged in between."""
    folder, points = _folder(spark), tables(spark, sf, "ad_points")[0]
    _digests(points).write.parquet(f"{folder}/digests")
    damaged = F.when(F.col("ad") % 7 == 3, F.col("h").bitwiseXOR(F.lit(1))).otherwise(F.col("h"))
    points.withColumn("h", damaged).write.parquet(f"{folder}/points")
    now = _digests(spark.read.parquet(f"{folder}/points")).withColumnRenamed("digest", "now")
    told = spark.read.parquet(f"{folder}/digests").join(now, "ad", "left")
    return told.select("ad", "digest", F.col("digest").eqNullSafe(F.col("now")).alias("valid"))


WALL = 1_704_100_000_000


@query("K8", with_("records") + f"SELECT origin, max(seq) + 1 AS seq, greatest(max(ts) + 1, {WALL}) AS ts FROM records GROUP BY origin")
def k8(spark, sf):
    """The number and time of the next record of each origin."""
    return ingest.next_numbers(tables(spark, sf, "records")[0], WALL)


@query("K11", with_("reports") + """, steps AS (SELECT *, row_number() OVER (PARTITION BY "user", file_key ORDER BY created, id) AS r, count(*) OVER (PARTITION BY "user", file_key) AS n FROM reports),
walk AS (SELECT "user", file_key, r, n, [{'id': id, 'p': pos_ms, 'c': created, 'x': 1}] AS kept FROM steps WHERE r = 1
  UNION ALL SELECT "user", file_key, r, n, CASE WHEN near IS NULL THEN list_append(kept, {'id': id, 'p': pos_ms, 'c': created, 'x': 1}) ELSE list_transform(kept, lambda k: CASE WHEN k.id = near THEN {'id': k.id, 'p': pos_ms, 'c': created, 'x': k.x + 1} ELSE k END) END FROM (
    SELECT s."user", s.file_key, s.r, s.n, s.id, s.pos_ms, s.created, w.kept,
      list_sort(list_transform(list_filter(w.kept, lambda k: abs(k.p - s.pos_ms) <= 10000), lambda k: {'d': abs(k.p - s.pos_ms), 'id': k.id}))[1].id AS near FROM walk w JOIN steps s ON s."user" = w."user" AND s.file_key = w.file_key AND s.r = w.r + 1)),
rows_ AS (SELECT unnest(kept) AS k FROM walk WHERE r = n)
SELECT k.id AS id, k.p AS pos_ms, k.c AS created, k.x AS times FROM rows_""")
def k11(spark, sf):
    """Reports in order of time: each moves the nearest earlier one of its user and file within 10 s, or is new."""

    def fold(rows: list[tuple]) -> list[tuple]:
        kept: dict[int, tuple] = {}
        for _, _, created, at, pos in rows:
            near = [(abs(k[0] - pos), i) for i, k in kept.items() if abs(k[0] - pos) <= 10_000]
            i = min(near)[1] if near else at
            kept[i] = (pos, created, kept[i][2] + 1 if near else 1)
        return [(i, *k) for i, k in kept.items()]

    reports = tables(spark, sf, "reports")[0].select("user", "file_key", "created", "id", "pos_ms")
    return folded(reports, ["user", "file_key"], ["created", "id"], fold, "id long, pos_ms long, created long, times long")


@query("K13", with_("pins") + "SELECT ad FROM pins WHERE ad NOT IN (37, 74) UNION SELECT unnest([5, 6, 0])")
def k13(spark, sf):
    change = lambda *x: spark.createDataFrame([(i,) for i in x], "ad long")
    return tables(spark, sf, "pins")[0].join(change(37, 74), "ad", "left_anti").unionByName(change(5, 6, 0)).distinct()


_POLICY = "SELECT origin, name, CAST(weight AS DOUBLE) AS weight, blocked, managed FROM origin_policy WHERE NOT managed AND origin NOT IN (4, 1000) UNION ALL SELECT 4, 'four', 3.0, false, true UNION ALL SELECT 1000, 'new', NULL, true, true"


def _policy(spark, sf):
    given = spark.createDataFrame([(4, "four", 3.0, False, True), (1000, "new", None, True, True)], "origin long, name string, weight double, blocked boolean, managed boolean")
    return tables(spark, sf, "origin_policy")[0].where("NOT managed").join(given.select("origin"), "origin", "left_anti").unionByName(given)


@query("K14", with_("origin_policy") + _POLICY)
def k14(spark, sf):
    """Managed rows replaced by those of the settings; others stay unless they name the same origin."""
    return _policy(spark, sf)


@query("X15", with_("ads", "origin_policy") + ", now AS (" + _POLICY + f") SELECT a.id, {catalogue.w('a.author')} AS w FROM ads a LEFT JOIN now p ON p.origin = a.author")
def x15(spark, sf):
    ads = tables(spark, sf, "ads")[0]
    return c.weighed(ads.select("id", "author"), _policy(spark, sf), SELF, "author").select("id", F.col("w").cast("double").alias("w"))


@query("K15", with_("ads", "retractions", "ad_adds", "votes_log") + ", " + catalogue._LIVE + ", " + catalogue._VOTES + f""" SELECT a.id, 'ad.add' AS kind, CAST(NULL AS BIGINT) AS value, max(l.ts) + 1 AS ts FROM ads a JOIN live l ON l.ad = a.id AND l.origin = a.author GROUP BY a.id
UNION ALL SELECT DISTINCT v.ad, 'ad.vote', 1, v.ts + 1 FROM votes v JOIN ads a ON a.id = v.ad JOIN live l ON l.ad = a.id AND l.origin = a.author WHERE v.origin = {SELF} AND v.value < 0""")
def k15(spark, sf):
    """Adding retracted ads again: a newer record for each, and where the own node had voted it down, a vote for it."""
    ads, r, adds, log = tables(spark, sf, "ads", "retractions", "ad_adds", "votes_log")
    gone = c.live_retractions(r, adds).select(F.col("ad").alias("id"), F.col("origin").alias("author"), "ts")
    back = ads.select("id", "author").join(gone, ["id", "author"]).groupBy("id").agg((F.max("ts") + 1).alias("ts"))
    down = c.latest(log, "ad", "origin").where((F.col("origin") == SELF) & (F.col("value") < 0)).select(F.col("ad").alias("id"), (F.col("ts") + 1).alias("ts"))
    flips = down.join(back.select("id"), "id", "left_semi")
    return back.select("id", F.lit("ad.add").alias("kind"), F.lit(None).cast("long").alias("value"), "ts").unionByName(flips.select("id", F.lit("ad.vote").alias("kind"), F.lit(1).cast("long").alias("value"), "ts"))


@query("K16", with_("ads", "own_detections") + f"SELECT id, CASE WHEN author IS NULL OR author = {SELF} THEN 'ad.retract' ELSE 'ad.vote' END AS kind, CASE WHEN author IS NULL OR author = {SELF} THEN NULL ELSE 'not_ad' END AS reason, count(d.ad) AS removed FROM ads a LEFT JOIN own_detections d ON d.ad = a.id GROUP BY a.id, a.author")
def k16(spark, sf):
    """Retracting each ad: the record that says so, and the own detections that go with it."""
    ads, own = tables(spark, sf, "ads", "own_detections")
    mine = F.col("author").isNull() | (F.col("author") == SELF)
    removed = own.groupBy(F.col("ad").alias("id")).agg(F.count("*").alias("removed"))
    return ads.join(removed, "id", "left").select("id", F.when(mine, "ad.retract").otherwise("ad.vote").alias("kind"), F.when(~mine, "not_ad").alias("reason"), F.coalesce("removed", F.lit(0)).alias("removed"))


@query("K17", with_("ads", "votes_log", "labels_log", "dups") + ", " + catalogue._VOTES + f""", mine AS (SELECT * FROM labels_log QUALIFY row_number() OVER (PARTITION BY ad, origin ORDER BY ts DESC, seq DESC) = 1)
SELECT id, 'ad.label' AS kind, 'named ' || type AS said FROM ads a WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.ad = a.id AND m.origin = {SELF} AND m.label = 'named ' || a.type)
UNION ALL SELECT id, 'ad.vote', '1' FROM ads a WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.ad = a.id AND v.origin = {SELF} AND v.value = 1)
UNION ALL SELECT id, 'ad.dup', CAST(id * 7 % 200 AS VARCHAR) FROM ads a WHERE id <> id * 7 % 200 AND id * 7 % 200 IN (SELECT id FROM ads) AND NOT EXISTS (SELECT 1 FROM dups d WHERE d.ad = a.id AND d.origin = {SELF} AND d.canonical = a.id * 7 % 200)""")
def k17(spark, sf):
    """Labels, votes and duplicate claims of the own node for each ad: a record for each that changes what it has said."""
    ads, log, labels, dups = tables(spark, sf, "ads", "votes_log", "labels_log", "dups")
    own = lambda df: df.where(F.col("origin") == SELF)
    asked = lambda kind, said, rows: rows.select("id", F.lit(kind).alias("kind"), said.cast("string").alias("said"))
    changed = lambda rows, have: rows.join(have, ["id", "said"], "left_anti").select("id", "kind", "said")
    have = lambda df, said: df.select(F.col("ad").alias("id"), F.col(said).cast("string").alias("said"))
    canonical = F.col("id") * 7 % 200
    known = ads.where(canonical != F.col("id")).withColumn("canonical", canonical).join(ads.select(F.col("id").alias("canonical")), "canonical", "left_semi")
    said = changed(asked("ad.label", F.concat(F.lit("named "), "type"), ads), have(own(c.latest(labels, "ad", "origin")), "label"))
    said = said.unionByName(changed(asked("ad.vote", F.lit(1), ads), have(own(c.latest(log, "ad", "origin")), "value")))
    return said.unionByName(changed(asked("ad.dup", F.col("canonical"), known), have(own(dups), "canonical")))


@query("K18", with_("ads", "ad_adds") + "SELECT id FROM ads WHERE (author IS NULL OR author = 1) AND fp_version = 1 AND id NOT IN (SELECT ad FROM ad_adds)")
def k18(spark, sf):
    ads, adds = tables(spark, sf, "ads", "ad_adds")
    return ads.where("(author IS NULL OR author = 1) AND fp_version = 1").join(adds.select(F.col("ad").alias("id")), "id", "left_anti").select("id")


_V = "greatest(1, CAST(ceil(length(bin({})) / 7.0) AS BIGINT))"


@query("K19", with_("records") + f"SELECT id, p + {_V.format('p')} AS bytes FROM (SELECT id, 1 + length(kind) + 32 + {_V.format('seq')} + {_V.format('2 * ts')} + 1 + 2 + 64 AS p FROM records)")
def k19(spark, sf):
    from ..sources import records as source

    r = tables(spark, sf, "records")[0].select("id", "kind", F.unhex(F.sha2(F.col("origin").cast("string"), 256)).alias("origin"), "seq", "ts", F.lit(bytearray(b"{}")).alias("body"), F.lit(bytearray(64)).alias("sig"))
    return source.encoded(r).select("id", F.octet_length("frame").cast("long").alias("bytes"))


@query("K20", match_plans.ORACLE["T10"])
def k20(spark, sf):
    """The index written in order and read again."""
    path = _folder(spark) + "/index"
    m.index(tables(spark, sf, "ad_points")[0]).write.parquet(path)
    return spark.read.parquet(path)


@query("K23", with_("dets") + "SELECT file, '{\"file\":\"' || file || '\",\"detections\":' || count(*) || ',\"best\":' || max(score) || '}' AS json FROM dets GROUP BY file")
def k23(spark, sf):
    n = tables(spark, sf, "dets")[0].groupBy("file").agg(F.count("*").alias("detections"), F.max("score").alias("best"))
    return n.select("file", F.to_json(F.struct("file", "detections", "best")).alias("json"))


@query("W3", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY value DESC, event_id) <= 30")
def w3(spark, sf):
    """The strongest 30 of each bucket, as SQL does it; the kernel does it on arrays."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rank = F.row_number().over(Window.partitionBy(hour).orderBy(F.desc("value"), "event_id"))
    return tables(spark, sf, "events")[0].withColumn("rank", rank).where("rank <= 30").select("event_id")


@query("W5")
def w5(spark, sf):
    def run(batches):
        for b in batches:
            for ad, pcm in zip(b["ad"], b["pcm"], strict=True):
                t, f = fingerprint.peaks(fingerprint.spectrogram(pcm))
                yield pd.DataFrame({"ad": ad, "frame": t, "bin": f})

    return scalar._pcm(spark, sf).mapInPandas(run, "ad long, frame long, bin long")


@query("W6")
def w6(spark, sf):
    return detect.candidates(tables(spark, sf, "blocks")[0]).select("file", "ad", "agree")


@query("W7", with_("intervals") + """, d AS (SELECT file, ord, from_ms, lead(from_ms) OVER (PARTITION BY file ORDER BY from_ms, ord) - from_ms AS gap FROM intervals)
SELECT file, ord, last_value(CASE WHEN gap <= 7200000 THEN gap END IGNORE NULLS) OVER (PARTITION BY file ORDER BY from_ms, ord ROWS UNBOUNDED PRECEDING) AS dur FROM d""")
def w7(spark, sf):
    """How long each frame lasts: until the next if that is near, else as long as the one before."""
    w = Window.partitionBy("file").orderBy("from_ms", "ord")
    gap = F.lead("from_ms").over(w) - F.col("from_ms")
    rows = tables(spark, sf, "intervals")[0].withColumn("gap", gap)
    return rows.select("file", "ord", F.last(F.when(F.col("gap") <= 7_200_000, F.col("gap")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("dur"))


@query("W8", "SELECT event_id, f + (p - f + 4294967296 + 8589934592) % 8589934592 - 4294967296 AS pts FROM (SELECT event_id, event_id * 100000007 % 8589934592 AS p, first_value(event_id * 100000007 % 8589934592) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)")
def w8(spark, sf):
    """33-bit clocks unwrapped around the first reading."""
    p = F.col("event_id") * 100_000_007 % (1 << 33)
    rows = tables(spark, sf, "events")[0].withColumn("p", p).withColumn("f", F.first("p").over(Window.partitionBy("user_id").orderBy("event_id")))
    return rows.select("event_id", (F.col("f") + F.pmod(F.col("p") - F.col("f") + (1 << 32), F.lit(1 << 33)) - (1 << 32)).alias("pts"))


@query("T9", with_("dets") + "SELECT file, string_agg(start_ms || ':' || ad, ',' ORDER BY start_ms, ord) AS ads FROM dets GROUP BY file")
def t9(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "ord", "ad")))
    text = F.array_join(F.transform("r", lambda e: F.concat_ws(":", e["start_ms"].cast("string"), e["ad"].cast("string"))), ",")
    return tables(spark, sf, "dets")[0].groupBy("file").agg(rows.alias("r")).select("file", text.alias("ads"))


@query("F22", with_("ads") + "SELECT id, coalesce(nullif(source_key, 'k3'), '-') AS a, greatest(id, duration_ms) AS b, least(id, 7) AS c, abs(id - 50) AS d, instr(label, 'r') AS e, substr(label, 2, 3) AS f, (type, id) < ('b', 100) AS g FROM ads")
def f22(spark, sf):
    pair = F.struct(F.col("type").alias("x"), F.col("id").alias("y")) < F.struct(F.lit("b").alias("x"), F.lit(100).cast("long").alias("y"))
    x = tables(spark, sf, "ads")[0]
    return x.select("id", F.coalesce(F.nullif(F.col("source_key"), F.lit("k3")), F.lit("-")).alias("a"), F.greatest("id", "duration_ms").alias("b"), F.least("id", F.lit(7)).alias("c"), F.abs(F.col("id") - 50).alias("d"), F.instr("label", "r").cast("long").alias("e"), F.substring("label", 2, 3).alias("f"), pair.alias("g"))


def _sessions(gap: int) -> str:
    return f""", g AS (SELECT *, from_ms - lag(from_ms) OVER (PARTITION BY file ORDER BY from_ms, ord) > {gap} AS new FROM intervals),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY from_ms, ord ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT file, min(from_ms) AS opened, max(from_ms) + {gap} AS closed, count(*) AS events FROM s GROUP BY file, n"""


def _session_query(gap: int):
    def run(spark, sf):
        """Sessions that close when nothing comes for a while."""
        w = Window.partitionBy("file").orderBy("from_ms", "ord")
        new = F.when(F.col("from_ms") - F.lag("from_ms").over(w) > gap, 1).otherwise(0)
        rows = tables(spark, sf, "intervals")[0].withColumn("new", new)
        rows = rows.withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy("file", "n").agg(F.min("from_ms").alias("opened"), (F.max("from_ms") + gap).alias("closed"), F.count("*").alias("events")).drop("n")

    return run


query("R7", with_("intervals") + _sessions(600_000))(_session_query(600_000))


@query("R16", with_("own_detections", "peer_detections") + "SELECT key, ad, start_ms, 'own' AS side FROM own_detections WHERE confirmed UNION ALL SELECT key, ad, start_ms, 'remote' FROM peer_detections r WHERE NOT EXISTS (SELECT 1 FROM own_detections o WHERE o.key = r.key AND o.ad = r.ad AND r.start_ms < o.end_ms AND o.start_ms < r.end_ms)")
def r16(spark, sf):
    """What a session starts with: the own confirmed detections, and the others' where there are no own ones."""
    own, peer = tables(spark, sf, "own_detections", "peer_detections")
    pick = lambda d, side: d.select("key", "ad", "start_ms", F.lit(side).alias("side"))
    return pick(own.where("confirmed"), "own").unionByName(pick(iv.without_overlapping(peer, own), "remote"))


@query("U9", with_("ads") + "SELECT id FROM ads WHERE id IN (2, 3, 5, 7, 11)")
def u9(spark, sf):
    ids = spark.createDataFrame([('["2", "3", "5", "7", "11"]',)], "ids string").select(F.explode(F.from_json("ids", "array<string>")).alias("id")).select(F.col("id").cast("bigint").alias("id"))
    return tables(spark, sf, "ads")[0].join(F.broadcast(ids), "id", "left_semi").select("id")


@query("U8", with_("records") + f"SELECT origin, max(seq) + 1 AS seq, origin % 7 <> 3 AS sig_ok FROM records GROUP BY origin")
def u8(spark, sf):
    """The next record of each origin, signed with the origin's key and checked as a receiver does; that of some is changed on the way."""
    from ..functions import codec, ed25519

    def run(batches):
        for b in batches:
            received = []
            for origin, seq, ts in zip(b["origin"].tolist(), b["seq"].tolist(), b["ts"].tolist(), strict=True):
                seed = hashlib.sha256(f"origin {origin}".encode()).digest()
                public = ed25519.public_key(seed)
                signed = codec.DOMAIN + f"ad.add\0{origin}\0{seq}\0{ts}".encode()
                sig = ed25519.sign(seed, public, signed)
                received.append((public, signed + b"!" * (origin % 7 == 3), sig))
            ok = ed25519.verify_many(received)
            yield pd.DataFrame({"origin": b["origin"], "seq": b["seq"], "sig_ok": ok})

    # the rows are few bytes and much work; only a round robin of a given number of tasks is neither dropped nor coalesced
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ingest.next_numbers(tables(spark, sf, "records")[0], WALL).repartition(tasks).mapInPandas(run, "origin long, seq long, sig_ok boolean")


@query("X3", with_("peers") + "SELECT n_name AS name, coalesce(p.received, 0) AS received FROM nation LEFT JOIN peers p ON p.name = n_name")
def x3(spark, sf):
    nation, peers = tables(spark, sf, "nation", "peers")
    return nation.select(F.col("n_name").alias("name")).join(peers, "name", "left").select("name", F.coalesce("received", F.lit(0).cast("long")).alias("received"))


@query("X6")
def x6(spark, sf):
    """A scan of whole files: confirmed candidates with the file's coverage."""
    blocks = tables(spark, sf, "blocks")[0]
    covered = iv.as_sets(iv.union(blocks.select("file", F.col("block_from").alias("from_ms"), F.col("block_to").alias("to_ms")), "file"), "file")
    found = detect.candidates(blocks).where("confirmed")
    return covered.join(found, "file", "left").select("file", iv.covered_ms(F.col("ranges")).alias("analyzed_ms"), "ad", "start", "end", "score")


@query("X9", with_("file_maps") + "SELECT key, duration_ms * 1000000 AS duration_ns, CASE WHEN length(key) % 2 = 0 THEN 0 ELSE analyzed_ms END AS analyzed_ms FROM file_maps")
def x9(spark, sf):
    """Times in nanoseconds; the coverage of another fingerprint version counts for nothing."""
    version = F.when(F.length("key") % 2 == 0, 2).otherwise(F.col("fp_version"))
    return tables(spark, sf, "file_maps")[0].select("key", (F.col("duration_ms") * 1_000_000).alias("duration_ns"), F.when(version == 1, F.col("analyzed_ms")).otherwise(F.lit(0)).alias("analyzed_ms"))


@query("X10", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id:' || substr(sha256(c_name), 1, 32) WHEN c_custkey % 3 = 1 THEN 'ih:' || substr(sha256(c_name), 1, 40) || '/1' ELSE 'https://h.example/' || c_custkey END AS key FROM customer")
def x10(spark, sf):
    from ..functions import keys

    n = F.col("c_custkey") % 3
    own = F.when(n == 0, keys.opaque(F.col("c_name")))
    torrent = F.nullif(keys.torrent(F.when(n == 1, F.substring(F.sha2("c_name", 256), 1, 40)), F.lit("")), F.lit(""))
    url = F.concat(F.lit("https://u@H.example/"), F.col("c_custkey").cast("string"), F.lit("?token=1"))
    return tables(spark, sf, "customer")[0].select("c_custkey", F.coalesce(own, torrent, keys.normalised_url(url)).alias("key"))


@query("X11", with_("intervals") + ", " + interval_plans._islands(50) + " SELECT i.file, i.ord, EXISTS (SELECT 1 FROM islands s WHERE s.file = i.file AND s.from_ms <= i.from_ms + 50 AND s.to_ms >= i.from_ms + 10000 - 50) AS analysed FROM intervals i")
def x11(spark, sf):
    return interval_plans._asked(spark, sf).select("file", "ord", iv.contains(F.col("ranges"), F.col("from_ms"), F.col("from_ms") + 10_000).alias("analysed"))


@query("X12", with_("ads", "pins") + "SELECT 'pin' AS command, count(a.id) AS done, count(*) - count(a.id) AS failed FROM (SELECT p_partkey * 2 AS id FROM part) x LEFT JOIN ads a ON a.id = x.id UNION ALL SELECT 'unpin', count(p.ad), count(*) - count(p.ad) FROM (SELECT p_partkey * 2 AS id FROM part) x LEFT JOIN pins p ON p.ad = x.id")
def x12(spark, sf):
    """Pinning and unpinning a list of ids: how many were there to be changed."""
    ads, pins = tables(spark, sf, "ads", "pins")
    asked = ads.select((F.col("id") * 2).alias("id"))
    hits = lambda name, there: asked.join(there.withColumn("there", F.lit(1)), "id", "left").agg(F.count("there").alias("done"), (F.count("*") - F.count("there")).alias("failed")).select(F.lit(name).alias("command"), "done", "failed")
    return hits("pin", ads.select("id")).unionByName(hits("unpin", pins.select(F.col("ad").alias("id"))))


@query("X18", with_("ad_points", "ads") + match_plans._QUALITY + " SELECT q.ad, q.worst_ad, a.label, q.worst_score >= 3 AS over FROM quality q JOIN ads a ON a.id = q.worst_ad")
def x18(spark, sf):
    pts, ads = tables(spark, sf, "ad_points", "ads")
    pts = pts.withColumn("t", F.col("t") * 20)
    return m.quality(pts, pts).join(ads.select(F.col("id").alias("worst_ad"), "label"), "worst_ad").select("ad", "worst_ad", "label", (F.col("worst_score") >= 3).alias("over"))


@query("R8", with_("intervals") + "SELECT file, ord FROM intervals i JOIN (SELECT file, max(to_ms) AS newest FROM intervals GROUP BY file) USING (file) WHERE to_ms > newest - 2700000")
def r8(spark, sf):
    """What a store of the last 45 minutes by media time still holds."""
    rows = tables(spark, sf, "intervals")[0]
    return rows.join(rows.groupBy("file").agg(F.max("to_ms").alias("newest")), "file").where(F.col("to_ms") > F.col("newest") - 2_700_000).select("file", "ord")


@query("R15", with_("ads") + "SELECT id, id % 40 * 1000 AS start_ms, id % 40 * 1000 + duration_ms AS end_ms FROM ads WHERE n_points >= 50 AND duration_ms BETWEEN 3000 AND 180000")
def r15(spark, sf):
    """Marks that can be enrolled, each a confirmed detection of itself."""
    marks = tables(spark, sf, "ads")[0].where((F.col("n_points") >= 50) & F.col("duration_ms").between(3000, 180_000))
    return marks.select("id", (F.col("id") % 40 * 1000).alias("start_ms"), (F.col("id") % 40 * 1000 + F.col("duration_ms")).alias("end_ms"))


