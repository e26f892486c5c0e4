"""Folds, clusters and interval sets against published cases and naive versions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonarium.operators import catalogue, detect, ingest, intervals
from sonarium.operators import match as m


def block(low, high, *dets):
    return [{"block_from": low, "block_to": high, "ad": None, "start": None, "end": None, "score": None}] + [{"block_from": low, "block_to": high, "ad": a, "start": s, "end": e, "score": v} for a, s, e, v in dets]


def confirmed(rows, score):
    return [c["confirmed"] for c in detect.fold_candidates(rows, score)]


def test_two_agreeing_blocks_confirm():
    det = (1, 100_000, 130_000, 60)
    one = block(110_000, 120_000, det)
    assert confirmed(one, 40) == [False]
    assert confirmed(one + block(120_000, 130_000, det), 40) == [True]
    assert confirmed(one + block(120_000, 130_000, det), 200) == [False]
    assert confirmed(one + block(200_000, 210_000, det), 40) == [False]


def test_whole_coverage_confirms():
    rows = block(100_000, 110_000, (1, 100_000, 130_000, 9)) + block(110_000, 120_000) + block(120_000, 130_000)
    assert confirmed(rows, 200) == [True]


def test_replacement_starts_anew():
    rows = block(0, 10_000, (1, 0, 30_000, 50)) + block(10_000, 20_000, (1, 0, 30_000, 50)) + block(20_000, 30_000, (1, 2_000, 32_000, 90))
    (c,) = detect.fold_candidates(rows, 40)
    assert (c["start"], c["agree"], c["confirmed"]) == (2_000, 1, False)


def test_cluster_of_three_origins(spark):
    policy = spark.createDataFrame([(1, 2.0, False), (2, 0.5, False), (3, 0.5, False)], "origin long, weight double, blocked boolean")
    dets = spark.createDataFrame([("k", o, 7, 5000 + 100 * i, 9000, 50 + i, i == 1) for i, o in enumerate((1, 2, 3))], "key string, origin long, ad long, start_ms long, end_ms long, score long, confirmed boolean")
    (row,) = catalogue.cluster(dets, policy, 99).collect()
    assert (row.weight, row.score, row.confirmed, row.origins, row.start_ms) == (3.0, 52, True, 3, 5200)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=40, unique=True))
def test_anchors_equal_a_walk(spark, starts):
    from pyspark.sql import functions as F

    starts = sorted(starts)
    want, anchor = [], None
    for s in starts:
        anchor = s if anchor is None or s - anchor > 250 else anchor
        want.append(anchor)
    got = spark.createDataFrame([(starts,)], "s array<bigint>").select(catalogue.anchored(F.col("s")).alias("a")).first().a
    assert got == want


def test_union_and_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("f", 10_000, 20_000), ("f", 30_000, 40_000), ("f", 19_000, 31_000)], "file string, from_ms long, to_ms long")
    sets = intervals.as_sets(intervals.union(df, "file"), "file")
    gap = lambda a, b: intervals.first_gap(F.col("ranges"), F.lit(a), F.lit(b))
    row = sets.select("ranges", gap(0, 50_000).alias("a"), gap(15_000, 50_000).alias("b"), gap(12_000, 38_000).alias("c")).first()
    assert [tuple(r) for r in row.ranges] == [(10_000, 40_000)]
    assert tuple(row.a) == (0, 10_000) and tuple(row.b) == (40_000, 50_000) and row.c is None


def test_shadow(spark):
    rows = [("f", 1, 100_000, 130_000, 300, 1), ("f", 2, 120_000, 135_000, 100, 2), ("f", 3, 129_000, 144_000, 50, 3)]
    df = spark.createDataFrame(rows, "file string, ad long, start_ms long, end_ms long, score long, ord long")
    assert {r.ad for r in intervals.without_shadowed(df).collect()} == {1, 3}


def test_windows_cover_every_sample(spark):
    sizes = [0, 1, 79_999, 103_999, 104_000, 104_001, 184_000, 500_001]
    df = spark.createDataFrame([(str(n), n) for n in sizes], "file string, n long")
    found = {}
    for r in intervals.windows(df).orderBy("file", "win").collect():
        found.setdefault(int(r.file), []).append(r)
    assert 0 not in found
    for n, rows in found.items():
        assert rows[0].from_n == 0 and rows[-1].to_n == n and rows[-1].high == n
        assert all(a.to_n == b.from_n and a.high - a.low == 104_000 for a, b in zip(rows, rows[1:], strict=False))


def test_labels_take_the_best_detection(spark):
    det = lambda start, score, n: ("f", 1, start, start + 30_000, score, n)
    truth = spark.createDataFrame([("f", 1, 100_000, 130_000, 1)], "file string, ad long, start_ms long, end_ms long, label_id long")
    frame = lambda *d: spark.createDataFrame(list(d), "file string, ad long, start_ms long, end_ms long, score long, ord long")
    assert detect.assigned(truth, frame(det(110_000, 5, 1), det(100_020, 9, 2))).first().det == 2
    assert detect.assigned(truth, frame(det(120_000, 9, 1))).first().det is None


def test_any_order_gives_the_same_rows(spark):
    log = [(a, o, f"label{i}", 100 + i % 5, i) for i, (a, o) in enumerate([(1, 1), (1, 2), (2, 1)] * 6)]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(log)
        df = spark.createDataFrame(log, "ad long, origin long, label string, ts long, seq long")
        results.add(tuple(sorted(tuple(r) for r in catalogue.latest(df, "ad", "origin").collect())))
    assert len(results) == 1


def test_ingest_matrix(spark):
    policy = spark.createDataFrame([(5, True)], "origin long, blocked boolean")
    stored = spark.createDataFrame([(1, 1, "h1", 1_700_000_000_000)], "origin long, seq long, hash string, received long")
    now = 1_700_000_000_000
    good = dict(kind="ad.add", ts=now, sig_ok=True, body_len=10)
    rows = [(1, 1, 1, "h1", *good.values()), (2, 1, 1, "other", *good.values()), (3, 5, 1, "b", *good.values()), (4, 2, 1, "t", "ad.add", now, False, 10), (5, 2, 2, "k", "Bad", now, True, 10)]
    rows += [(6, 3, 1, "f", "ad.add", now + 700_000, True, 10), (7, 4, 1, "a", *good.values()), (8, 4, 2, "b2", *good.values()), (9, 4, 3, "c", *good.values()), (10, 4, 1, "a", *good.values())]
    batch = spark.createDataFrame(rows, "arrival long, origin long, seq long, hash string, kind string, ts long, sig_ok boolean, body_len long")
    got = {r.arrival: r.outcome for r in ingest.outcomes(batch, stored, policy, now, 2, 99).collect()}
    assert got == {1: "duplicate", 2: "invalid", 3: "blocked", 4: "signature", 5: "invalid", 6: "future", 7: "accepted", 8: "accepted", 9: "quota", 10: "duplicate"}


def test_refiling(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    aliases = spark.createDataFrame([("x", "a"), ("y", "b")], "alias string, key string")
    k, al = ingest.refile(keys, aliases, "c", ["x"])
    assert sorted(r.key for r in k.collect()) == ["b", "c"]
    assert sorted(tuple(r) for r in al.collect()) == [("a", "c"), ("x", "c"), ("y", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_peaks_equal_a_naive_vote(spark, seed):
    from collections import Counter

    rng = random.Random(seed)
    ads = [(a, rng.randrange(40), rng.randrange(60)) for a in range(4) for _ in range(60)]
    query = [(q, rng.randrange(40), rng.randrange(60)) for q in range(3) for _ in range(60)]
    votes = Counter((q, a, t2 - t) for q, h, t in query for a, h2, t2 in ads if h == h2)
    want = set()
    for (q, a, off), v in votes.items():
        prev, after = votes.get((q, a, off - 1), 0), votes.get((q, a, off + 1), 0)
        if prev < v and after <= v and prev + v + after >= 5:
            want.add((q, a, off, prev + v + after))
    got = m.match(spark.createDataFrame(query, "q long, h long, t long"), spark.createDataFrame(ads, "ad long, h long, t long"), 5)
    assert {tuple(r) for r in got.collect()} == want
