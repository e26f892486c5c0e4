"""Readers of media containers: exact round trips, and damaged files that neither fail nor hang."""

import random
import time

import pytest

from sonarium.plans import containers as w
from sonarium.sources import containers as c

KINDS = {"matroska": (w.matroska, c.matroska, 0), "mp4": (w.mp4, c.mp4, 0), "fragments": (w.mp4_fragments, c.mp4, 0), "mpegts": (w.mpegts, c.mpegts, w.FIRST_STAMP // 90), "avi": (w.avi, c.avi, 0)}


def parts_of(n, rng):
    return [rng.randbytes(rng.choice([1000, 1000, 37, 600, 1])) for _ in range(n)]


@pytest.mark.parametrize("kind", KINDS)
def test_round_trip(kind):
    write, read, first = KINDS[kind]
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 7, 24, 90):
        parts = parts_of(n, rng)
        got = list(read(write(parts)))
        assert [d for _, d in got] == parts
        assert [t // 1_000_000 for t, _ in got] == [first + i * w.STEP for i in range(n)]


@pytest.mark.parametrize("kind", KINDS)
def test_damaged_files_end(kind):
    write, read, _ = KINDS[kind]
    rng = random.Random(5)
    whole = write(parts_of(20, rng))
    start = time.monotonic()
    for _ in range(400):
        b = bytearray(whole[: rng.choice([len(whole), rng.randrange(len(whole))])])
        for _ in range(rng.randrange(6)):
            if b:
                b[rng.randrange(min(len(b), rng.choice([600, len(b)])))] = rng.choice([0, 255, 1, 0x47, rng.randrange(256)])
        assert sum(len(d) for _, d in read(bytes(b))) <= 50 * len(whole)
    assert time.monotonic() - start < 60


def test_matroska_goes_on_after_a_damaged_cluster():
    parts = parts_of(30, random.Random(6))
    b = bytearray(w.matroska(parts))
    second = b.find(c.CLUSTER.to_bytes(4, "big"), b.find(c.CLUSTER.to_bytes(4, "big")) + 4)
    b[second : second + 12] = bytes(12)
    got = [d for _, d in c.matroska(bytes(b))]
    assert got[:6] == parts[:6] and got[-18:] == parts[-18:]


def test_transport_packets_of_192_bytes_and_lost_sync():
    parts = parts_of(12, random.Random(7))
    b = w.mpegts(parts)
    timed = b"".join(bytes(4) + b[i : i + 188] for i in range(0, len(b), 188))
    assert [d for _, d in c.mpegts(timed)] == parts
    assert [d for _, d in c.mpegts(b"\1\2\3" + b)] == parts


def test_rows_without_media_give_nothing(spark):
    rows = [("a", None), ("b", bytearray()), ("c", bytearray(b"no media at all, but long enough")), ("d", bytearray(w.avi([b"x"])))]
    got = c.packets(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r.container, r.n, r.time_ns, bytes(r.data)) for r in got] == [("d", "avi", 0, 0, b"x")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "one.mkv").write_bytes(w.matroska([b"a", b"bc"]))
    got = c.packets(c.files(spark, f"file://{tmp_path}")).collect()
    assert [(r.container, bytes(r.data)) for r in got] == [("matroska", b"a"), ("matroska", b"bc")]
