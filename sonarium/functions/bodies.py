"""Bodies of records: their JSON, what is wrong with one, and what it says in a line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import codec, keys

#: Limits of bodies.
MAX_LABEL, MAX_KEY, MAX_VERSION, MAX_DURATION, MIN_LANDMARKS = 200, 128, 65_536, 600_000, 50
MAX_ALIASES, MAX_DETECTIONS, MAX_RANGES, MIN_POSITION = 16, 1000, 10_000, -60_000
TYPES, REASONS = ("ad", "intro"), ("good", "not_ad", "boundary", "duplicate")

#: All fields of the six kinds; a body has those of its kind, and leaves out empty ones.
SCHEMA = """id string, fp_version long, duration_ms long, points string, label string, type string, source struct<key:string,start_ms:long,end_ms:long>, supersedes string,
ad string, value long, reason string, key string, start_ms long, canonical string,
aliases array<string>, size long, analyzed array<array<long>>, ads array<struct<ad:string,start_ms:long,end_ms:long,score:long,confirmed:boolean>>"""


def decoded(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


@F.pandas_udf(LongType())
def landmarks(points: pd.Series) -> pd.Series:
    """How many landmarks a blob holds; -1 if it is none."""

    def count(x: bytes | None) -> int:
        try:
            return len(codec.decode(bytes(x))) if x is not None else -1
        except codec.Corrupt:
            return -1

    return points.map(count).astype("int64")


def _bad_id(x: Column) -> Column:
    return x.isNull() | ~x.rlike("^[0-9a-f]{32}$") | (x == "0" * 32)


def _bad_label(x: Column) -> Column:
    return F.coalesce((F.length(x) > MAX_LABEL) | x.rlike(r"\p{Cntrl}"), F.lit(False))


def _bad_type(x: Column) -> Column:
    return F.coalesce((x != "") & ~x.isin(*TYPES), F.lit(False))


def _bad_key(x: Column) -> Column:
    return x.isNull() | (F.octet_length(x) > MAX_KEY) | ~keys.storable(x)


def _bad_range(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (start < MIN_POSITION) | (end <= start)


def _bad_version(x: Column) -> Column:
    return x.isNull() | ~x.between(1, MAX_VERSION)


def fault(kind: Column, b: Column) -> Column:
    """The first thing wrong with a body (of SCHEMA) of its kind; null if nothing is, and for kinds that are not known."""
    blob = F.try_to_binary(b["points"], F.lit("base64"))
    n = landmarks(F.when(kind == "ad.add", blob))
    some = lambda xs, bad: F.coalesce(F.exists(xs, bad), F.lit(False))
    many = lambda xs, most: F.coalesce(F.size(xs) > most, F.lit(False))
    add = (
        F.when(_bad_id(b["id"]), "id")
        .when(_bad_version(b["fp_version"]), "version")
        .when(b["duration_ms"].isNull() | ~b["duration_ms"].between(1, MAX_DURATION), "duration")
        .when(b["supersedes"].isNotNull() & (_bad_id(b["supersedes"]) | (b["supersedes"] == b["id"])), "supersedes")
        .when(n < MIN_LANDMARKS, "landmarks")
        .when(F.lower(F.hex(codec.content_id(blob))) != b["id"], "hash")
        .when(_bad_label(b["label"]), "label")
        .when(_bad_type(b["type"]), "type")
        .when(b["source"].isNotNull() & _bad_key(b["source"]["key"]), "key")
        .when(b["source"].isNotNull() & _bad_range(b["source"]["start_ms"], b["source"]["end_ms"]), "range")
    )
    vote = (
        F.when(_bad_id(b["ad"]), "ad")
        .when(b["value"].isNull() | ~b["value"].isin(1, -1), "value")
        .when(b["reason"].isNull() | ~b["reason"].isin(*REASONS), "reason")
        .when(F.coalesce(b["key"] != "", F.lit(False)) & _bad_key(b["key"]), "key")
    )
    maps = (
        F.when(_bad_key(b["key"]) | some(b["aliases"], _bad_key), "key")
        .when(many(b["aliases"], MAX_ALIASES) | many(b["ads"], MAX_DETECTIONS) | many(b["analyzed"], MAX_RANGES), "many")
        .when(_bad_version(b["fp_version"]), "version")
        .when((F.coalesce(b["size"], F.lit(0)) < 0) | (F.coalesce(b["duration_ms"], F.lit(0)) < 0), "negative")
        .when(some(b["analyzed"], lambda r: _bad_range(F.get(r, F.lit(0)), F.get(r, F.lit(1)))), "range")
        .when(some(b["ads"], lambda d: _bad_id(d["ad"])), "ad")
        .when(some(b["ads"], lambda d: _bad_range(d["start_ms"], d["end_ms"])), "range")
    )
    return (
        F.when(b.isNull(), "json")
        .when(kind == "ad.add", add)
        .when(kind == "ad.label", F.when(_bad_id(b["ad"]), "ad").when(_bad_type(b["type"]), "type").when(_bad_label(b["label"]), "label"))
        .when(kind == "ad.vote", vote)
        .when((kind == "ad.dup") & (_bad_id(b["ad"]) | _bad_id(b["canonical"]) | (b["ad"] == b["canonical"])), "ad")
        .when((kind == "ad.retract") & _bad_id(b["ad"]), "ad")
        .when(kind == "file.map", maps)
    )


def summary(kind: Column, b: Column, ad: Column) -> Column:
    """What a body says about an ad, in a line: length, version and label; label; vote; the other ad of a duplicate claim; else empty."""
    quoted = F.to_json(F.array(b["label"]))
    quoted = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    named = F.coalesce(b["label"], F.lit("")) != ""
    add = F.concat(F.format_string("%.1f s, fp v%d", b["duration_ms"] / 1000, b["fp_version"]), F.when(named, F.concat(F.lit(", "), quoted)).otherwise(""))
    where = F.when(F.coalesce(b["key"], F.lit("")) != "", F.concat(F.lit(" @ "), b["key"])).otherwise("")
    vote = F.concat(F.format_string("%+d %s", b["value"], b["reason"]), where)
    dup = F.when(b["ad"] == ad, F.concat(F.lit("→ "), b["canonical"])).otherwise(F.concat(F.lit("← "), b["ad"]))
    said = F.when(kind == "ad.add", add).when(kind == "ad.label", F.coalesce(quoted, F.lit('""'))).when(kind == "ad.vote", vote).when(kind == "ad.dup", dup)
    return F.coalesce(said, F.lit(""))
