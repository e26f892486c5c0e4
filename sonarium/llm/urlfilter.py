"""Temporal URL filter lists.

Dated entries of a block or allow list become validity intervals; every capture
is judged by the entries that were active when it was fetched. A verdict
depends only on host, leading directories and date, so captures are reduced to
these before they meet the list, and to the (entry, day) pairs that the list
could answer. Those and the interval starts then go through one ordered pass
per entry: the last start before a day is the one that decides, however long
the history of an entry. No capture meets an interval of another time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import let

_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The lower-case host without user and port; null if the URL has none."""
    raw = F.lower(F.regexp_extract(url, _URL + r"([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(raw, "^.*@", ""), ":[0-9]*$", "")
    return F.when(host != "", host)


def directories_of(url: Column, most: int) -> Column:
    """The first directories of the path, at most so many; an empty segment ends them."""
    path = F.regexp_extract(url, _URL + r"[^/?#]*/([^?#]*)", 1)
    return let(F.slice(F.split(F.coalesce(path, F.lit("")), "/", -1), 1, most), lambda x: F.slice(x, 1, F.coalesce(F.nullif(F.array_position(x, "").cast("int"), F.lit(0)) - 1, F.size(x))))


def entries_of(host: Column, directories: Column, labels: int) -> Column:
    """The list entries that could name a capture: the host and its parents, of at most so many labels, and the host with its leading directories."""
    parents = let(F.split(host, r"\.", -1), lambda x: let(F.slice(x, F.greatest(F.lit(1), F.size(x) - labels + 1), F.lit(labels)), lambda y: F.transform(F.sequence(F.lit(1), F.size(y)), lambda i: F.array_join(F.slice(y, i, F.size(y)), "."))))
    below = F.transform(F.slice(F.sequence(F.lit(0), F.size(directories)), F.lit(2), F.size(directories)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(directories, F.lit(1), i), "/")))
    return F.concat(parents, below)


def intervals(events: DataFrame) -> DataFrame:
    """(entry, category, action, valid_from, valid_to) from events (entry, category, action block or allow, at date, added boolean).

    An entry holds from a day on which it is added until the next day on which
    it is added again or removed; valid_to is null while it still holds. Of
    several events for one day an addition wins. Events with a null entry,
    category, action or day are void. Days are reduced before the ordering, so
    one entry with many events costs one row a day.
    """
    days = events.dropna(subset=["entry", "category", "action", "at"]).groupBy("entry", "category", "action", "at").agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    order = Window.partitionBy("entry", "category", "action").orderBy("at")
    return days.withColumn("valid_to", F.lead("at").over(order)).where("added").select("entry", "category", "action", F.col("at").alias("valid_from"), "valid_to")


def active(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """(entry, f, category, action, valid_from, valid_to) of the intervals that hold at each (entry, f) of asked: one as-of pass.

    For each entry, category and action the starts and the days asked about are
    put in order, a start before a day it shares; each day sees the last start
    before it. A day is there once for an entry, however many captures have it.
    """
    lists = spans.select("entry", "category", "action").distinct()
    days = asked.select("entry", "f").dropna().distinct().join(lists, "entry").select("entry", "category", "action", F.col("f").alias("at"), F.lit(True).alias("asks"), F.lit(None).cast("struct<valid_from:date,valid_to:date>").alias("span"))
    starts = spans.select("entry", "category", "action", F.col("valid_from").alias("at"), F.lit(False).alias("asks"), F.struct("valid_from", "valid_to").alias("span"))
    order = Window.partitionBy("entry", "category", "action").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = days.unionByName(starts).withColumn("span", F.last("span", ignorenulls=True).over(order)).where("asks AND span IS NOT NULL")
    return seen.where("span.valid_to IS NULL OR at < span.valid_to").select("entry", F.col("at").alias("f"), "category", "action", "span.valid_from", "span.valid_to")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with verdict (block, allow or none), entry, category, valid_from and valid_to of the entry that decided.

    An entry names a host with all below it, or a host with leading
    directories. Of the active entries the longest decides; of equally long
    ones (the same entry) allow comes before block, then the smallest category.
    A capture without host or date, and every capture where the list is empty,
    has the verdict none. Repeated captures each keep their row. Columns of
    captures with the new names are replaced.
    """
    new = ["verdict", "entry", "category", "valid_from", "valid_to"]
    captures = captures.drop(*new)
    spans = intervals(events)
    deepest = spans.agg(F.max(F.size(F.split("entry", "/", -1)) - 1).alias("depth"), F.max(F.size(F.split(F.substring_index("entry", "/", 1), r"\.", -1))).alias("labels")).first()
    depth, labels = deepest.depth or 0, deepest.labels or 1
    host, below, found = (common.free_name(captures, n) for n in ("host", "below", "found"))
    keyed = captures.withColumn(host, host_of(F.col(url))).withColumn(below, F.array_join(directories_of(F.col(url), depth) if depth else F.array().cast("array<string>"), "/"))
    asked = keyed.select(F.col(host).alias("h"), F.coalesce(F.col(below), F.lit("")).alias("d"), F.col(fetched).alias("f")).dropna().distinct()
    directories = F.when(F.col("d") == "", F.array().cast("array<string>")).otherwise(F.split("d", "/", -1))
    named = asked.withColumn("entry", F.explode(entries_of(F.col("h"), directories, labels))).join(spans.select("entry").distinct(), "entry", "left_semi")
    # of one entry allow comes before block, then the smallest category
    of_entry = active(named, spans).groupBy("entry", "f").agg(F.min(F.struct("action", "category", "valid_from", "valid_to")).alias("x"))
    best = F.max_by(F.struct("entry", "x"), F.length("entry")).alias("best")
    verdicts = named.join(of_entry, ["entry", "f"]).groupBy("h", "d", "f").agg(best).select("h", "d", "f", F.struct("best.x.action", "best.entry", "best.x.category", "best.x.valid_from", "best.x.valid_to").alias(found))
    joined = keyed.join(verdicts, (F.col(host) == F.col("h")) & (F.coalesce(F.col(below), F.lit("")) == F.col("d")) & (F.col(fetched) == F.col("f")), "left")
    return joined.select(*(F.col(c) for c in captures.columns), F.coalesce(F.col(found)["action"], F.lit("none")).alias("verdict"), *(F.col(found)[c].alias(c) for c in new[1:]))


def stand_in_list(pages: DataFrame) -> DataFrame:
    """Dated list events for the hosts of pages, since the tables hold no list: a rule on the hash of each host decides."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).dropna().distinct().withColumn("x", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    x = F.col("x")
    first = x % 365
    event = lambda cond, entry, category, action, at, added: F.when(cond, F.struct(entry.alias("entry"), F.lit(category).alias("category"), F.lit(action).alias("action"), day(at).alias("at"), F.lit(added).alias("added")))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    rows = F.array_compact(
        F.array(
            event(x % 3 == 0, F.col("host"), "spam", "block", first, True),
            event((x % 3 == 0) & (x % 2 == 0), F.col("host"), "spam", "block", first + 30 + x % 200, False),
            event((x % 3 == 0) & (x % 5 == 0), F.col("host"), "spam", "block", first + 300, True),
            event(x % 7 == 0, parent, "malware", "block", first + 100, True),
            event(x % 11 == 0, F.col("host"), "reviewed", "allow", first + 50, True),
            event(x % 13 == 0, F.concat("host", F.lit("/de")), "section", "block", first, True),
        )
    )
    return hosts.select(F.explode(rows).alias("e")).select("e.*")


def op4_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, fetched, verdict, entry, category, valid_from, valid_to) of every page, against the stand-in list."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")))
    return judge(captures, stand_in_list(pages)).select("page_id", "url", "fetched", "verdict", "entry", "category", "valid_from", "valid_to")


ORACLE_SQL = r"""
WITH keyed AS (
  SELECT page_id, url, CAST('2024-01-01' AS DATE) + CAST((page_id * 7919) % 730 AS INTEGER) AS fetched,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS dir FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS x FROM keyed WHERE host <> ''),
events AS (
  SELECT host AS entry, 'spam' AS category, 'block' AS action, x % 365 AS day, true AS added FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT host, 'spam', 'block', x % 365 + 30 + x % 200, false FROM hosts WHERE x % 3 = 0 AND x % 2 = 0
  UNION ALL SELECT host, 'spam', 'block', x % 365 + 300, true FROM hosts WHERE x % 3 = 0 AND x % 5 = 0
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'malware', 'block', x % 365 + 100, true FROM hosts WHERE x % 7 = 0
  UNION ALL SELECT host, 'reviewed', 'allow', x % 365 + 50, true FROM hosts WHERE x % 11 = 0
  UNION ALL SELECT host || '/de', 'section', 'block', x % 365, true FROM hosts WHERE x % 13 = 0),
days AS (SELECT entry, category, action, CAST('2024-01-01' AS DATE) + CAST(day AS INTEGER) AS day, bool_or(added) AS added FROM events GROUP BY ALL),
spans AS (SELECT entry, category, action, day AS valid_from, lead(day) OVER (PARTITION BY entry, category, action ORDER BY day) AS valid_to, added FROM days),
named AS (
  SELECT page_id, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS entry
    FROM keyed, generate_series(1, 127) g(i) WHERE host <> '' AND i <= len(string_split(host, '.'))
  UNION ALL SELECT page_id, fetched, host || '/' || dir FROM keyed WHERE host <> '' AND dir <> ''),
ranked AS (
  SELECT n.page_id, n.entry, s.category, s.action, s.valid_from, s.valid_to,
    row_number() OVER (PARTITION BY n.page_id ORDER BY length(n.entry) DESC, s.action, s.category) AS r
  FROM named n JOIN spans s ON s.entry = n.entry AND s.added AND s.valid_from <= n.fetched AND (s.valid_to IS NULL OR n.fetched < s.valid_to))
SELECT k.page_id, k.url, k.fetched, coalesce(r.action, 'none') AS verdict, r.entry, r.category, r.valid_from, r.valid_to
FROM keyed k LEFT JOIN ranked r ON r.page_id = k.page_id AND r.r = 1"""

QUERIES = {"op4_temporal_list": op4_temporal_list}
ORACLE = {"op4_temporal_list": ORACLE_SQL}
