"""Queries on tables as large copies have them: large ids, repeated rows, many keys."""

import base64
import datetime
import hashlib
import random
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sonarium.functions import ed25519, keys
from sonarium.plans import registry


def events(path, rows):
    """rows: (id, ms of the day, user)."""
    day = datetime.datetime(2024, 1, 1)
    n = len(rows)
    columns = {"event_id": [r[0] for r in rows], "ts": pa.array([day + datetime.timedelta(milliseconds=r[1]) for r in rows], pa.timestamp("us")), "user_id": [r[2] for r in rows]}
    pq.write_table(pa.table(columns | {"event_type": ["error"] * n, "value": [1.0] * n, "props": ['{"k": 1}'] * n}), f"{path}/events.parquet")


def sql_rows(name, path, *names):
    con = duckdb.connect()
    for t in names:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return sorted(con.sql(registry.ORACLE[name]).fetchall(), key=repr)


def test_near_reports_of_large_ids(spark, tmp_path):
    """J9 ranks by distance and id as its SQL does, also where ids pass a million or stand on several reports."""
    rng = random.Random(5)
    rows = [(k * 7_000_003 + 11 * n, rng.randrange(60_000), rng.randrange(4)) for k in range(4) for n in range(60)]
    events(tmp_path, [(9_000_000, 170_000, 1), (1, 170_003, 1), (2, 170_001, 1), (500, 280_000, 1), (500, 286_000, 1), (501, 288_000, 1), (502, 279_000, 1), *rows])
    got = registry.QUERIES["J9"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sql_rows("J9", tmp_path, "events")
    targets = {(r["id"], r["target"]) for r in got}
    assert (1, 2) in targets and (2, 1) in targets and (500, 501) in targets


def test_torrent_keys_of_many_rows(spark):
    """keys of hex and base32 hashes and of stream URLs come at the pace of a table's rows, each as its plain version."""
    hashes = [hashlib.sha1(str(n).encode()).hexdigest() for n in range(40)]
    forms = [f for h in hashes for f in (h, h.upper(), base64.b32encode(bytes.fromhex(h)).decode(), base64.b32encode(bytes.fromhex(h)).decode().lower())] + ["0" * 40, "A" * 32, "7" * 32, "1" * 32, "torrs", "", None]
    df = spark.createDataFrame([(f,) for f in forms], "h string")
    plain = lambda h: h.lower() if len(h) == 40 else base64.b32decode(h.upper()).hex() if len(h) == 32 and h[0] != "1" else h
    got = df.select("h", keys.torrent(F.col("h"), F.lit("2")).alias("k"), keys.stream_key(F.concat(F.lit("http://t/stream?index=4&link="), "h")).alias("s"), keys.base32(F.lower("h")).alias("b")).collect()
    for h, k, s, b in got:
        assert k == (f"ih:{plain(h)}/2" if h else "")
        assert s == (f"ih:{plain(h)}/4" if h and len(plain(h)) == 40 else "")
        assert len(h or "") != 40 or b == base64.b32encode(bytes.fromhex(h)).decode()
    # a value that stands many times in an expression is evaluated as often, and makes methods that are too large to be compiled
    h = F.sha2(F.col("h"), 256)
    for key in (keys.torrent(h, F.lit("2")), keys.stream_key(h), keys.infohash(h), keys.base32(h)):
        assert df.select(key.alias("k"))._jdf.queryExecution().analyzed().toString().count("sha2(") == 1


def test_signatures_of_many_origins(spark, monkeypatch):
    """U8: signatures against sums of doublings, altered ones included; the work is dealt out to all cores, and a signature takes few additions."""
    seeds = [hashlib.sha256(bytes([n])).digest() for n in range(30)]
    for n, seed in enumerate(seeds):
        public = ed25519.public_key(seed)
        sig = ed25519.sign(seed, public, b"m%d" % n)
        point, bits = (0, 1, 1, 0), ed25519._secret(seed)[0]
        for bit in bin(bits)[2:]:
            point = ed25519._add(point, point)
            point = ed25519._add(point, ed25519.BASE) if bit == "1" else point
        assert ed25519._packed(point) == public
        assert ed25519._packed(ed25519._times(bits, ed25519.BASE)) == public
        assert ed25519.verify(public, b"m%d" % n, sig)
        for bad in (bytes([sig[0] ^ 1]) + sig[1:], sig[:31] + bytes([sig[31] ^ 128]) + sig[32:], sig[:40] + bytes([sig[40] ^ 4]) + sig[41:], sig[:-1]):
            assert not ed25519.verify(public, b"m%d" % n, bad)
        assert not ed25519.verify(public, b"m", sig) and not ed25519.verify(seeds[0], b"m%d" % n, sig)
    times = ed25519._times(ed25519.ORDER, ed25519.BASE)
    assert ed25519._packed(times) == ed25519._packed((0, 1, 1, 0)) == ed25519._packed(ed25519._times_base(ed25519.ORDER)) == ed25519._packed(ed25519._times(0, ed25519.BASE))
    rows = [(ed25519.public_key(x), b"m", ed25519.sign(x, ed25519.public_key(x), b"m")) for x in seeds]
    rows += [(p, b"n", g) for p, _, g in rows] + [(p, m, bytes([g[0] ^ 1]) + g[1:]) for p, m, g in rows] + [(b"", b"m", b""), (b"\xff" * 32, b"m", rows[0][2])]
    assert ed25519.verify_many(rows) == [ed25519.verify(*r) for r in rows] == [True] * 30 + [False] * 62
    edges = [0, 1, 15, 16, ed25519.ORDER - 1, ed25519.ORDER, 2**256 - 1, *range(10**70, 10**76, 10**75 // 3)]
    for p in (ed25519.BASE, ed25519._point(rows[1][0]), (0, 1, 1, 0), (0, ed25519.P - 1, 1, 0)):
        assert [*map(ed25519._packed, ed25519._times_many(edges, [p] * len(edges)))] == [ed25519._packed(ed25519._times(n, p)) for n in edges]
    u8 = registry.QUERIES["U8"](spark, "/root/testdata/sf0.001")
    u8.collect()
    assert u8.rdd.getNumPartitions() >= 4
    add, calls = ed25519._add, []
    monkeypatch.setattr(ed25519, "_add", lambda a, b: calls.append(1) or add(a, b))
    public = ed25519.public_key(seeds[0])
    assert ed25519.verify(public, b"x", ed25519.sign(seeds[0], public, b"x"))
    assert len(calls) < 150  # bit by bit some 1500
