"""Settings, snapshots, debouncing and adoption of keys on cases of their own."""

import random

import pytest
from pyspark.sql import functions as F

from sonarium.functions import codec
from sonarium.operators import ingest
from sonarium.sources import config, records


@pytest.mark.parametrize(
    ("text", "faults"),
    [
        ("nothing: 1", ["nothing"]),
        ("log: {level: loud, format: xml}", ["log.level", "log.format"]),
        ("detect: {min_score: -2, idle_timeout: 5 minutes}", ["detect.min_score", "detect.idle_timeout"]),
        ("metrics: {listen: 'host:0'}", ["metrics.listen"]),
        ("trust: {origins: {xyz: {weight: 1}}}", ["trust.origins.xyz"]),
        (f"trust: {{origins: {{{'ab' * 32}: {{weight: -1}}}}}}", [f"trust.origins.{'ab' * 32}.weight"]),
        ("auth: {users: {'a b': {}}}", ["auth.users.a b"]),
        ("auth: {users: {a: {tokens: ['x y']}}}", ["auth.users.a.tokens"]),
        ("sync: {peers: [{url: 'http://x'}]}", ["sync.peers[0].name"]),
        ("- 1", ["yaml"]),
        ("tracking: 5", ["tracking"]),
        ("public_url: 'https://a.example/?q=1'", ["public_url"]),
    ],
)
def test_faults_are_told_by_place(text, faults):
    with pytest.raises(config.Invalid) as e:
        config.load(text)
    assert e.value.faults == faults


def test_durations():
    assert [config.duration(x) for x in ("1h30m", "1.5s", "10ms", "-2m", 0)] == [5400 * 10**9, 1_500_000_000, 10_000_000, -120 * 10**9, 0]
    for bad in ("", "5", "5 s", "1h x"):
        with pytest.raises(ValueError):
            config.duration(bad)


def test_empty_settings_are_the_defaults():
    assert config.load("") == config.load("trust:\n") == config.DEFAULTS


def test_a_folder_without_a_node_is_no_snapshot(spark, tmp_path):
    with pytest.raises(codec.Corrupt):
        records.read_snapshot(spark, f"file://{tmp_path}/none")
    rows = [(1, "ad.add", bytearray(32), 1, 5, bytearray(b"{}"), bytearray(64))]
    log = spark.createDataFrame(rows, "id long, kind string, origin binary, seq long, ts long, body binary, sig binary")
    records.write_snapshot(f"file://{tmp_path}/s", "me", log)
    node, read = records.read_snapshot(spark, f"file://{tmp_path}/s")
    assert node == "me" and [(r.kind, r.seq, r.ts) for r in read.collect()] == [("ad.add", 1, 5)]


def test_debounced_against_a_walk(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(2000)) for n in range(5) for _ in range(120)] + [(9, 7), (9, 7)]
    want = []
    for n in sorted({n for n, _ in rows}):
        due = None
        for ms in sorted(m for k, m in rows if k == n):
            if due is None or ms >= due:
                due = ms + 25
                want.append((n, due))
    got = ingest.debounced(spark.createDataFrame(rows, "node long, ms long"), 25)
    assert sorted(map(tuple, got.collect())) == want
    assert ingest.debounced(spark.createDataFrame([], "node long, ms long"), 25).count() == 0


def test_content_keys_are_adopted_once(spark):
    rows = [("session:1", ["a"], "c:1"), ("u", [], "c:1"), ("u", ["c:1"], "c:1"), ("c:1", [], "c:1"), ("u", [], None)]
    got = ingest.adopted(spark.createDataFrame(rows, "key string, aliases array<string>, content string"))
    assert [(r.key, r.aliases) for r in got.collect()] == [("c:1", ["a"]), ("u", ["c:1"]), ("u", ["c:1"]), ("c:1", []), ("u", [])]


def test_files_newer_than_the_last_enrolment_keep_their_coverage(spark):
    maps = spark.createDataFrame([("a", 5, 70), ("b", 6, 70)], "key string, updated long, analyzed_ms long")
    enrolled = spark.createDataFrame([(2,), (5,)], "ts long")
    left = lambda e: {r.key: r.analyzed_ms for r in ingest.rescanned(maps, e).collect()}
    assert left(enrolled) == {"a": 0, "b": 70}
    assert left(enrolled.where(F.lit(False))) == {"a": 70, "b": 70}


def test_candidates_of_a_stream_equal_those_of_the_batch(spark, sf_dir):
    from sonarium.plans import registry

    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).select("file", "ad", "start", "end", "score", "agree", "confirmed").collect()), key=repr)
    assert rows("R1_stream") == rows("R1") != []
