"""Projections of the plain tables onto the shapes that the operators work on.

Each projection is one SQL text for both Spark and the checking engine, but for
a few functions that differ, which stand as macros: @NAME[argument].
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The own node.
SELF = 1

_MACROS = {
    # milliseconds since 1970 of a timestamp without zone, rounded down
    "MS": (lambda x: f"unix_millis(CAST({x} AS TIMESTAMP))", lambda x: f"(epoch_us({x}) // 1000)"),
    # the first 24 bits of the MD5 of a string
    "H24": (lambda x: f"CAST(conv(substr(md5({x}), 1, 6), 16, 10) AS BIGINT)", lambda x: f"CAST('0x' || substr(md5({x}), 1, 6) AS BIGINT)"),
    "PROP": (lambda x: f"CAST(get_json_object({x}, '$.k') AS BIGINT)", lambda x: f"CAST(json_extract_string({x}, '$.k') AS BIGINT)"),
    # the lower-case words of a text, and one row for each pair of neighbours: its position and both words
    "WORDS": (lambda x: rf"regexp_extract_all(lower({x}), '\\pL+', 0)", lambda x: rf"regexp_extract_all(lower({x}), '\pL+')"),
    "PAIRS": (lambda x: f"LATERAL posexplode(zip_with({x}, slice({x}, 2, greatest(size({x}), 1)), (a, b) -> a || ' ' || b)) AS w(pos, word)", lambda x: f"LATERAL (SELECT unnest(list_transform({x}, lambda a, i: a || ' ' || {x}[i + 1])) AS word, unnest(range(len({x}))) AS pos) w"),
    "UNHEX": (lambda x: f"unhex({x})", lambda x: f"unhex({x})"),
}

PROJECTIONS = {
    "ad_points": "SELECT d.ad, @H24[w.word] AS h, CAST(w.pos AS BIGINT) AS t FROM (SELECT CAST(item_id AS BIGINT) AS ad, @WORDS[text] AS ws FROM {benchmark}) d, @PAIRS[d.ws] WHERE w.word IS NOT NULL",
    "q_points": "SELECT d.q, @H24[w.word] AS h, CAST(w.pos AS BIGINT) AS t FROM (SELECT CAST(doc_id AS BIGINT) AS q, @WORDS[text] AS ws FROM {documents}) d, @PAIRS[d.ws] WHERE w.word IS NOT NULL",
    "peer_detections": """SELECT 'k' || CAST(l_orderkey % 50 AS STRING) AS key, l_suppkey AS origin, l_partkey % 40 AS ad,
        CAST(l_linenumber * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS BIGINT) AS start_ms,
        CAST(l_linenumber * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 + 15000 + (l_partkey % 40) * 500 AS BIGINT) AS end_ms,
        CAST(max(l_quantity) AS BIGINT) AS score, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS confirmed
        FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "own_detections": """SELECT 'k' || CAST(l_orderkey % 50 AS STRING) AS key, l_partkey % 40 AS ad,
        CAST(l_linenumber * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS BIGINT) AS start_ms,
        CAST(l_linenumber * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000 + 15000 + (l_partkey % 40) * 500 AS BIGINT) AS end_ms,
        CAST(max(l_quantity) AS BIGINT) AS score, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS confirmed
        FROM {lineitem} WHERE l_suppkey % 9 = 0 GROUP BY 1, 2, 3, 4""",
    "peer_maps": """SELECT 'k' || CAST(l_orderkey % 50 AS STRING) AS key, l_suppkey AS origin, CAST(max(l_linenumber) * 10000 + 60000 AS BIGINT) AS duration_ms,
        max(@MS[l_shipdate]) AS ts, count(*) AS seq FROM {lineitem} GROUP BY 1, 2""",
    "file_maps": """SELECT 'k' || CAST(l_orderkey % 50 AS STRING) AS key, CAST(max(l_linenumber) * 10000 + 60000 AS BIGINT) AS duration_ms,
        CAST(count(*) % 60 * 1500 AS BIGINT) AS analyzed_ms, max(@MS[l_shipdate]) AS updated, CAST(1 AS BIGINT) AS fp_version
        FROM {lineitem} WHERE l_suppkey % 9 = 0 AND l_orderkey % 50 < 40 GROUP BY 1""",
    "file_aliases": "SELECT DISTINCT 'a' || CAST(o_orderkey % 90 AS STRING) AS alias, 'k' || CAST(o_orderkey % 90 % 50 AS STRING) AS key FROM {orders}",
    "origin_policy": """SELECT s_suppkey AS origin, s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE CAST((s_nationkey % 5) * 0.5 AS DOUBLE) END AS weight,
        s_acctbal < 0 AS blocked, s_suppkey % 4 = 0 AS managed FROM {supplier}""",
    "ads": """SELECT p_partkey AS id, p_name || ' ' || p_brand AS label, CASE WHEN p_size % 7 = 0 THEN 'intro' ELSE 'ad' END AS type, p_partkey * 1000 AS created,
        CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 97 END AS author, CAST(CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS fp_version,
        CAST(p_size * 1000 + 15000 AS BIGINT) AS duration_ms, CAST(p_size * 12 AS BIGINT) AS n_points, md5(CAST(p_partkey AS STRING)) AS hex_id,
        CASE WHEN p_partkey % 3 = 0 THEN 'k' || CAST(p_partkey % 50 AS STRING) END AS source_key FROM {part}""",
    "votes_log": """SELECT ad, origin, value, reason, ts, CAST(row_number() OVER (PARTITION BY origin ORDER BY ts, o, n, ad, p) AS BIGINT) AS seq FROM (
        SELECT l_partkey % 200 AS ad, l_suppkey AS origin, CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS BIGINT) AS value,
        CASE WHEN l_returnflag = 'A' THEN 'good' WHEN l_linestatus = 'F' THEN 'not_ad' WHEN l_quantity > 25 THEN 'boundary' ELSE 'duplicate' END AS reason,
        @MS[l_shipdate] AS ts, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS p FROM {lineitem} WHERE l_returnflag <> 'N') cast_votes""",
    "labels_log": """SELECT o_orderkey % 150 AS ad, o_custkey % 60 AS origin, o_orderpriority || '/' || CAST(o_orderkey % 13 AS STRING) AS label, @MS[o_orderdate] AS ts, o_orderkey AS seq FROM {orders}""",
    "dups": "SELECT p_partkey % 200 AS ad, p_partkey % 20 AS origin, max(p_partkey * 7 % 200) AS canonical FROM {part} WHERE p_size % 4 = 0 GROUP BY 1, 2",
    "pins": "SELECT p_partkey AS ad FROM {part} WHERE p_partkey % 37 = 0",
    "ad_adds": "SELECT o_orderkey % 300 AS ad, o_orderkey % 97 AS origin, max(@MS[o_orderdate]) AS ts FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1, 2",
    "retractions": "SELECT o_orderkey % 300 AS ad, o_orderkey % 97 AS origin, max(@MS[o_orderdate]) AS ts FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 1, 2",
    "records": """SELECT event_id AS id, user_id AS origin, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
        CASE event_type WHEN 'signup' THEN 'ad.add' WHEN 'click' THEN 'ad.vote' WHEN 'error' THEN 'ad.dup' WHEN 'view' THEN 'ad.label' ELSE 'file.map' END AS kind,
        @PROP[props] AS ad, @MS[ts] AS ts, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS via, @MS[ts] + event_id % 1000 AS received, value
        FROM {events}""",
    "log6": """SELECT id, origin, seq, ts, CASE WHEN kind = 'file.map' AND id % 2 = 0 THEN 'ad.retract' ELSE kind END AS kind, ad, 'l' || CAST(id % 11 AS STRING) AS label,
        CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END AS value, ad * 7 % 100 AS canonical, 'k' || CAST(ad % 9 AS STRING) AS key FROM {records}""",
    "stored": "SELECT origin, seq, md5(CAST(id AS STRING)) AS hash, received FROM {records} WHERE id % 3 = 0",
    "batch": """SELECT CAST(id * 10 + v AS BIGINT) AS arrival, origin, seq, CASE WHEN v = 2 THEN md5('x' || CAST(id AS STRING)) ELSE md5(CAST(id AS STRING)) END AS hash,
        CASE WHEN id % 53 = 0 THEN 'Bad!' ELSE kind END AS kind, ts + CASE WHEN id % 29 = 0 THEN 100000000000 ELSE 0 END AS ts, id % 41 <> 0 AS sig_ok,
        CAST(CASE WHEN id % 31 = 0 THEN 300000 ELSE 100 END AS BIGINT) AS body_len
        FROM {records} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) versions
        WHERE (v = 0 AND id % 3 <> 0) OR (v = 1 AND id % 5 = 0) OR (v = 2 AND id % 7 = 0)""",
    "blocks": """SELECT 'c' || CAST(conv_id AS STRING) AS file, turn * 10000 AS block_from, turn * 10000 + 10000 AS block_to, length(text) % 4 AS ad,
        turn * 10000 - length(text) % 5 * 60 - 3000 AS start, turn * 10000 - length(text) % 5 * 60 + 9000 AS `end`, CAST(30 + length(text) % 23 AS BIGINT) AS score, turn AS ord FROM {conversations}""",
    "intervals": "SELECT user_id AS file, @MS[ts] AS from_ms, @MS[ts] + CAST(floor(value * 60000) AS BIGINT) AS to_ms, event_id AS ord FROM {events}",
    "reports": """SELECT event_id AS id, 'u' || CAST(user_id % 7 AS STRING) AS user, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'k' || CAST(user_id % 20 AS STRING) END AS file_key,
        'n' || CAST(user_id % 20 AS STRING) AS norm, CAST(@MS[ts] % 86400000 AS BIGINT) AS pos_ms, props AS note, @MS[ts] AS created FROM {events} WHERE event_type = 'error'""",
    "observations": "SELECT event_type AS family, value FROM {events}",
    "peers": "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_nationkey * 10 AS BIGINT) AS received FROM {nation} WHERE n_nationkey % 2 = 0",
    "configured": "SELECT n_name AS name, 'https://' || lower(n_name) || '.example' AS url FROM {nation} WHERE n_nationkey % 3 = 0",
    "dets": """SELECT 'k' || CAST(floor(l_orderkey / 64) AS BIGINT) AS file, l_partkey % 6 AS ad, CAST(l_linenumber * 20000 + CAST(floor(l_extendedprice) AS BIGINT) % 9000 AS BIGINT) AS start_ms,
        CAST(l_linenumber * 20000 + CAST(floor(l_extendedprice) AS BIGINT) % 9000 + 8000 + (l_partkey % 6) * 4000 AS BIGINT) AS end_ms, CAST(l_quantity AS BIGINT) AS score,
        CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 64) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ord FROM {lineitem}""",
    "truth": """SELECT 'k' || CAST(floor(o_orderkey / 64) AS BIGINT) AS file, o_orderkey % 6 AS ad, CAST(o_orderkey % 11 * 20000 + 3000 AS BIGINT) AS start_ms,
        CAST(o_orderkey % 11 * 20000 + 3000 + 8000 + (o_orderkey % 6) * 4000 AS BIGINT) AS end_ms, o_orderkey % 2 = 0 AS verified, o_orderkey AS label_id FROM {orders}""",
    "samples": "SELECT doc_id AS file, n_chars * 1000 AS n FROM {documents}",
    "urls": "SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN '?Token=abc' ELSE '?expires=9' END AS url FROM {pages}",
}


def _expand(sql: str, duck: bool) -> str:
    for name, pair in _MACROS.items():
        at = sql.find(f"@{name}[")
        while at >= 0:
            depth, end = 0, at + len(name) + 1
            for end in range(at + len(name) + 1, len(sql)):
                depth += (sql[end] == "[") - (sql[end] == "]")
                if not depth:
                    break
            sql = sql[:at] + pair[duck](sql[at + len(name) + 2 : end]) + sql[end + 1 :]
            at = sql.find(f"@{name}[")
    return sql


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores, where its files make fewer tasks than there are cores (a file of one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or else one of the plain tables."""
    if name not in PROJECTIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _expand(PROJECTIONS[name], False)
    used = {t: table(spark, sf_dir, t) for t in (*TABLES, *PROJECTIONS) if "{" + t + "}" in sql}
    if name == "q_points":  # words are the work here
        used["documents"] = spread(used["documents"])
    # braces of patterns are none of ours
    return spark.sql(sql, **used)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def ctes(*names: str) -> str:
    """The projections as common table expressions for the checking engine, without WITH."""
    return ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', _expand(PROJECTIONS[n], True))})" for n in names)


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ctes(*names) + "\n"
