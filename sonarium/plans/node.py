"""Queries of a node's own doings: settings, snapshots, adoption of keys, rescans, debouncing, metrics, and stores that streams keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import ingest as i
from ..operators import metrics
from ..sources import config, records
from ..streaming import state
from . import ingest as log_plans, more, scalar
from .fixtures import SELF, tables, with_
from .streams import _as_stream, _folder, _told

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str | None = None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


#: Settings texts and the faults that each has.
TEXTS = [
    ("", ""),
    ("trust: {min_trust: 2.5}\nlog: {level: warn, format: JSON}\n", ""),
    ("trust: {unknown: -1, nobody: 3}\n", "trust.unknown,trust.nobody"),
    ("sync:\n  peers:\n  - {name: a, url: 'https://a.example', interval: 5s}\n  - {name: b, url: 'https://u@b.example', mode: both}\n", "sync.peers[0].interval,sync.peers[1].url"),
    ("sync:\n  peers:\n  - {name: a, url: 'https://a.example', interval: 10m}\n  - {name: a, url: 'https://b.example'}\n", "sync.peers[1].name"),
    ("listen: ':1'\n---\nlisten: ':2'\n", "documents"),
    ("auth: {users: {ann: {tokens: [x1]}, bob: {tokens: [x1], admin: true}}}\n", "auth.users.bob.tokens"),
    ("a: [\n", "yaml"),
]


@query("S20", f"SELECT c_custkey, [{', '.join(repr(f) for _, f in TEXTS)}][c_custkey % {len(TEXTS)} + 1] AS faults, CASE c_custkey % {len(TEXTS)} WHEN 0 THEN 1.0 WHEN 1 THEN 2.5 END::DOUBLE AS min_trust FROM customer")
def s20(spark, sf):
    """Settings read: the places of their faults, and the trust that an ad needs where there are none."""
    text = F.get(F.array(*(F.lit(t) for t, _ in TEXTS)), (F.col("c_custkey") % len(TEXTS)).cast("int"))

    def run(batches):
        for b in batches:
            faults, trust = [], []
            for t in b["text"]:
                try:
                    trust.append(float(config.load(t)["trust"]["min_trust"]))
                    faults.append("")
                except config.Invalid as e:
                    trust.append(None)
                    faults.append(",".join(e.faults))
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "faults": faults, "min_trust": pd.Series(trust, dtype="float64")})

    return tables(spark, sf, "customer")[0].select("c_custkey", text.alias("text")).mapInPandas(run, "c_custkey long, faults string, min_trust double")


PAGE = 1000


@query("S9", with_(*log_plans._LOG) + ", " + log_plans._INGEST + f" SELECT arrival // {PAGE} AS page, outcome, count(*) AS n FROM judged GROUP BY ALL")
def s9(spark, sf):
    """A log written as a snapshot of frames, read again, and every record checked; outcomes by page of the file."""
    _, stored, batch, policy = tables(spark, sf, *log_plans._LOG)
    folder = _folder(spark)
    body = F.encode(F.to_json(F.struct("arrival", "origin", "hash", "sig_ok", "body_len")), "UTF-8")
    log = batch.select(F.col("arrival").alias("id"), "kind", F.unhex(F.sha2(F.col("origin").cast("string"), 256)).alias("origin"), "seq", "ts", body.alias("body"), F.lit(bytearray(64)).alias("sig"))
    records.write_snapshot(folder, "node", log)
    _, read = records.read_snapshot(spark, folder)
    rows = read.select("kind", "seq", "ts", F.from_json(F.decode("body", "UTF-8"), "arrival long, origin long, hash string, sig_ok boolean, body_len long").alias("b")).select("kind", "seq", "ts", "b.*")
    judged = i.outcomes(rows, stored, policy, log_plans.NOW, log_plans.QUOTA, SELF)
    return judged.groupBy(F.floor(F.col("arrival") / PAGE).alias("page"), "outcome").agg(F.count("*").alias("n"))


@query("R14", with_("peer_maps", "ad_adds") + f", enrolled AS (SELECT max(ts) AS newest FROM ad_adds WHERE origin = {SELF}) SELECT key, origin, CASE WHEN ts <= newest THEN 0 ELSE duration_ms END AS analyzed_ms FROM peer_maps, enrolled")
def r14(spark, sf):
    """Files to be analysed again once the own node has enrolled ads: what was analysed before the last of them counts no more."""
    maps, adds = tables(spark, sf, "peer_maps", "ad_adds")
    maps = maps.select("key", "origin", F.col("ts").alias("updated"), F.col("duration_ms").alias("analyzed_ms"))
    return i.rescanned(maps, adds.where(F.col("origin") == SELF)).select("key", "origin", "analyzed_ms")


@query("R17", f"""WITH c AS ({scalar._CONTENT.replace("doc_id", "page_id").replace("text", "html").replace("documents", "pages")}),
f AS (SELECT page_id, c.key AS content, CASE page_id % 3 WHEN 0 THEN 'session:' || page_id WHEN 1 THEN c.key ELSE 'https://x.example/' || page_id END AS key, CASE WHEN page_id % 2 = 0 THEN [c.key] ELSE ['a' || page_id] END AS aliases FROM c)
SELECT page_id, CASE WHEN key <> content AND NOT list_contains(aliases, content) AND starts_with(key, 'session:') THEN content ELSE key END AS key,
  array_to_string(CASE WHEN key <> content AND NOT list_contains(aliases, content) AND NOT starts_with(key, 'session:') THEN list_append(aliases, content) ELSE aliases END, ' ') AS aliases FROM f""")
def r17(spark, sf):
    """Pages as files of sessions whose ends have been seen: their content key replaces a provisional key or becomes an alias."""
    row = F.col("page_id").cast("string")
    rows = scalar.content_keys(tables(spark, sf, "pages")[0], "page_id", "html").withColumnRenamed("key", "content")
    n = F.col("page_id") % 3
    key = F.when(n == 0, F.concat(F.lit("session:"), row)).when(n == 1, F.col("content")).otherwise(F.concat(F.lit("https://x.example/"), row))
    aliases = F.when(F.col("page_id") % 2 == 0, F.array("content")).otherwise(F.array(F.concat(F.lit("a"), row)))
    return i.adopted(rows.withColumns({"key": key, "aliases": aliases})).select("page_id", "key", F.array_join("aliases", " ").alias("aliases"))


#: Nodes refresh once in an hour at most here: events of the tables are minutes apart.
WAIT = 3_600_000


@query("R12", with_("intervals") + f""", t AS (SELECT file % 50 AS node, from_ms AS ms FROM intervals),
walk AS (SELECT node, min(ms) + {WAIT} AS fired FROM t GROUP BY node UNION ALL
  SELECT w.node, min(t.ms) + {WAIT} FROM walk w JOIN t ON t.node = w.node AND t.ms >= w.fired GROUP BY w.node)
SELECT node, fired FROM walk""")
def r12(spark, sf):
    """Refreshes that triggers cause: one for all that come while it is pending."""
    triggers = tables(spark, sf, "intervals")[0].select((F.col("file") % 50).alias("node"), F.col("from_ms").alias("ms"))
    return i.debounced(triggers, WAIT)


#: Families of the metrics (fixed values): name, kind, labels, and of histograms the first bound, factor and count.
FAMILIES = [
    ("config_reloads_total", "counter", "result"),
    ("build_info", "gauge", "version go_version fingerprint_version"),
    ("catalog_write_duration_seconds", "histogram", "", 0.0005, 4.0, 8),
    ("records_ingested_total", "counter", "result reason"),
    ("catalog_db_wait_seconds_total", "counter", "pool"),
    ("catalog_db_in_use", "gauge", "pool"),
    ("catalog_db_bytes", "gauge", ""),
    ("analysed_media_seconds_total", "counter", ""),
    ("fingerprint_duration_seconds", "histogram", "", 0.001, 2.0, 10),
    ("confirmations_total", "counter", ""),
    ("match_duration_seconds", "histogram", "", 0.0005, 2.0, 10),
    ("library_builds_total", "counter", "result"),
    ("library_build_duration_seconds", "histogram", "", 0.1, 3.0, 7),
    ("library_ads", "gauge", ""),
    ("library_index_ads", "gauge", ""),
    ("library_postings", "gauge", ""),
    ("library_dead_ads", "gauge", ""),
    ("library_dead_postings", "gauge", ""),
    ("library_overlay_ads", "gauge", ""),
    ("library_overlay_postings", "gauge", ""),
    ("library_mapped_bytes", "gauge", ""),
    ("library_heap_bytes", "gauge", ""),
    ("library_last_build_timestamp_seconds", "gauge", ""),
    ("library_version", "gauge", ""),
    ("ffmpeg_running", "gauge", ""),
    ("ffmpeg_runs_total", "counter", "result"),
    ("ffmpeg_run_seconds", "histogram", "", 1.0, 4.0, 7),
    ("decoder_restarts_total", "counter", ""),
    ("pcm_ring_bytes", "gauge", ""),
    ("decoder_idle_frames_total", "counter", ""),
    ("sync_peers", "gauge", ""),
    ("sync_rounds_total", "counter", "peer result"),
    ("sync_round_duration_seconds", "histogram", "peer", 0.05, 4.0, 7),
    ("sync_last_success_timestamp_seconds", "gauge", "peer"),
    ("sync_pull_lag_records", "gauge", "peer"),
    ("sync_records_total", "counter", "peer direction"),
    ("backfills_total", "counter", "kind result"),
    ("upstream_requests_total", "counter", "result"),
    ("upstream_response_seconds", "histogram", "", 0.005, 3.0, 9),
    ("stream_bytes_total", "counter", ""),
    ("stream_copy_errors_total", "counter", ""),
    ("sessions_active", "gauge", ""),
    ("sessions_opened_total", "counter", "kind"),
    ("sessions_closed_total", "counter", "reason"),
    ("containers_total", "counter", "type"),
    ("analysis_disabled_total", "counter", "reason"),
    ("analyser_queue_bytes", "gauge", ""),
    ("analyser_stall_seconds_total", "counter", ""),
    ("analyser_skip_ahead_total", "counter", ""),
    ("analyser_dropped_bytes_total", "counter", ""),
    ("detections_total", "counter", ""),
    ("detection_score", "histogram", "", 10.0, 2.0, 8),
    ("file_map_requests_total", "counter", "result"),
    ("marks_total", "counter", "result"),
    ("reports_total", "counter", ""),
    ("http_requests_total", "counter", "handler method code"),
    ("http_request_duration_seconds", "histogram", "handler", 0.001, 4.0, 8),
    ("http_requests_in_flight", "gauge", "handler"),
]
_ROWS = ", ".join(str((*f[:3], *(f[3:] or ("", "", "")))).replace("''", "NULL") for f in FAMILIES)


@query("X14", f"SELECT name, kind, coalesce(labels, '') AS labels, CASE WHEN n IS NULL THEN 0 ELSE n END AS bounds, CAST(start * factor ** (n - 1) AS DOUBLE) AS last FROM (VALUES {_ROWS}) f(name, kind, labels, start, factor, n)")
def x14(spark, sf):
    """The catalogue of metrics, with the number and the last of their bounds."""
    rows = [(name, kind, labels, len(b), b[-1] if b else None) for name, kind, labels, *h in FAMILIES for b in [metrics.exponential_bounds(*h) if h else []]]
    return spark.createDataFrame(rows, "name string, kind string, labels string, bounds long, last double")


@query("U6", "SELECT doc_id, lower(text) AS folded FROM documents")
def u6(spark, sf):
    """A function of one's own in SQL texts: the folding of case, which keeps nulls; a SQL function, so that it is part of the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fold(x STRING) RETURNS STRING RETURN lower(x)")
    return spark.sql("SELECT doc_id, fold(text) AS folded FROM {documents}", documents=tables(spark, sf, "documents")[0])


#: The synthetic world (fixed values): ads, collisions, ads and maps of trash.
ADS, COLLISIONS, TRASH_ADS, TRASH_MAPS = 900, 60, 3500, 1800


def _draw(seed: str, n: int, low: int = 0) -> tuple[str, str]:
    """A number from low on, of n, that follows from seed and i, in both dialects."""
    h = f"substr(md5('{seed}' || CAST(i AS {{}})), 1, 6)"
    return f"({low} + CAST(conv({h.format('STRING')}, 16, 10) AS BIGINT) % {n})", f"({low} + CAST('0x' || {h.format('VARCHAR')} AS BIGINT) % {n})"


def _world(duck: int) -> str:
    d = lambda *a: _draw(*a)[duck]
    rows = lambda n: f"range({n}) r(i)" if duck else f"(SELECT id AS i FROM range({n}))"
    none, text = "CAST(NULL AS BIGINT)", "VARCHAR" if duck else "STRING"
    head = lambda part, kind: f"SELECT '{part}' AS part, i AS id, {kind} AS kind"
    return f"""{head("ad", f"CAST(NULL AS {text})")}, i % 3 AS origin, {d("length", 25001, 20000)} AS duration_ms, {none} AS of, {none} AS shift, {none} AS score FROM {rows(ADS)}
UNION ALL {head("collision", "CASE i % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'half' ELSE 'bed' END")}, (i + 1) % 3, CASE i % 3 WHEN 2 THEN {d("bed", 4001)} ELSE {d("length", 25001, 20000)} END, i, CASE i % 3 WHEN 0 THEN {d("shift", 4)} END, {none} FROM {rows(COLLISIONS)}
UNION ALL {head("vote", f"CASE WHEN {d('kind', 100)} < 5 THEN 'boundary' ELSE 'good' END")}, 0, {none}, i, {none}, {none} FROM {rows(ADS)} WHERE {d("vote", 100)} < 70
UNION ALL {head("trash", f"CASE WHEN {d('spam', 100)} < 60 THEN 'not_ad' END")}, 3, {d("short", 6001, 2000)}, {none}, {none}, {none} FROM {rows(TRASH_ADS)}
UNION ALL {head("map", f"CAST(NULL AS {text})")}, 3, {none}, {d("many", 20, 5)}, {none}, {d("score", 15, 20)} FROM {rows(TRASH_MAPS)}"""


@query("S22", _world(1))
def s22(spark, sf):
    """A synthetic world, from rules: honest ads of three origins and the votes on them, ads that collide with others (near copies, halves, shared beds), and the ads and maps of a spammer."""
    return spark.sql(_world(0))


#: After all events of the tables, by more than they may come late.
FAR = log_plans.NOW + 410 * i.DAY


@query("R7_stream", more.ORACLE["R7"])
def r7_stream(spark, sf):
    """Sessions of a stream of events that closes them when nothing comes for ten minutes; a last row far ahead moves the watermark on."""
    folder = _folder(spark)
    rows = tables(spark, sf, "intervals")[0].select("file", "from_ms")
    stream = _as_stream(rows, folder)
    spark.createDataFrame([(-1, FAR)], rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    q = state.sessions(stream, 600_000, "400 days", FAR).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("file", "opened", "closed", "events")


@query("R8_stream", more.ORACLE["R8"])
def r8_stream(spark, sf):
    """What the stores of the last 45 minutes hold after a whole stream, whatever order it came in."""
    folder = _folder(spark)
    stream = _as_stream(tables(spark, sf, "intervals")[0].select("file", "ord", "to_ms"), folder)
    return _told(state.recent(stream, 2_700_000), folder, "file").select("file", "ord")
