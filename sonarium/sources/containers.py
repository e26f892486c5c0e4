"""Audio packets of media files: Matroska, MP4, MPEG transport streams and AVI.

Each reader yields (time_ns, bytes) of the first audio track in the order of
the file. Damaged bytes never fail: a reader takes up again where the format
lets it (clusters, transport packets) and else ends with what came before.
Files come as rows of bytes (as Spark's binaryFile reader gives them), so one
file is what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as m

NS = 1_000_000_000
Packet = tuple[int, bytes]
PACKETS = "path string, container string, n long, time_ns long, data binary"


def _be(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "big")


def _le(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little")


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


# Matroska: element ids (fixed values)
SEGMENT, CLUSTER, TRACKS, INFO = 0x18538067, 0x1F43B675, 0x1654AE6B, 0x1549A966
TRACK, TRACK_NUMBER, TRACK_TYPE, TRACK_DEFAULT_DURATION, CODEC_DELAY = 0xAE, 0xD7, 0x83, 0x23E383, 0x56AA
SCALE, TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1
AUDIO = 2


def _vint(b: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None where there is none, -1 for a size that is not known."""
    if at >= end or not b[at]:
        return None, at
    n = 9 - b[at].bit_length()
    if at + n > end:
        return None, at
    x = _be(b, at, n)
    if keep:
        return x, at + n
    x &= (1 << 7 * n) - 1
    return (-1 if x == (1 << 7 * n) - 1 else x), at + n


def _elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two places; an element that does not fit ends them."""
    while at < end:
        key, at = _vint(b, at, end, keep=True)
        size, at = _vint(b, at, end)
        if key is None or size is None:
            return
        stop = end if size < 0 else at + size
        if stop > end:
            return
        yield key, at, stop
        at = stop


def _laced(b: bytes, at: int, end: int, kind: int) -> list[bytes]:
    """The frames of a block: 0 one, 1 sizes in steps of 255, 2 equal sizes, 3 differences of sizes."""
    if not kind:
        return [b[at:end]]
    count, at = (b[at] + 1 if at < end else 0), at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // count if count else 0] * count
    else:
        for i in range(count - 1):
            size = 0
            if kind == 1:
                while at < end:
                    size, at = size + b[at], at + 1
                    if b[at - 1] < 255:
                        break
            else:
                start = at
                x, at = _vint(b, at, end)
                if x is None:
                    return []
                size = x if i == 0 else sizes[-1] + x - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            return []
        out.append(b[at : at + size])
        at += size
    return out


def matroska(b: bytes) -> Iterator[Packet]:
    """Blocks of clusters; times less the codec's delay. Clusters of unknown size end where the next begins."""
    scale, track, step, delay = 1_000_000, None, 0, 0
    at = b.find(SEGMENT.to_bytes(4, "big"))
    if at < 0:
        return
    _, at = _vint(b, at + 4, len(b))
    while at < len(b):
        key, start = _vint(b, at, len(b), keep=True)
        size, start = _vint(b, start, len(b))
        known = key in (CLUSTER, TRACKS, INFO) or key is not None and size is not None and 0 <= size <= len(b) - start
        if not known or size is None:  # damaged: on to the next cluster
            at = b.find(CLUSTER.to_bytes(4, "big"), at + 1)
            if at < 0:
                return
            continue
        stop = start + size
        if size < 0:
            stop = b.find(CLUSTER.to_bytes(4, "big"), start)
        stop = len(b) if stop < 0 else min(stop, len(b))
        if key == INFO:
            for k, s, e in _elements(b, start, stop):
                scale = _be(b, s, e - s) or scale if k == SCALE else scale
        elif key == TRACKS and track is None:
            for k, s, e in _elements(b, start, stop):
                found = {x: _be(b, i, min(j - i, 8)) for x, i, j in _elements(b, s, e)}
                if k == TRACK and found.get(TRACK_TYPE) == AUDIO:
                    track, step, delay = found.get(TRACK_NUMBER), found.get(TRACK_DEFAULT_DURATION, 0), found.get(CODEC_DELAY, 0)
                    break
        elif key == CLUSTER:
            time = 0
            for k, s, e in _elements(b, start, stop):
                if k == TIME:
                    time = _be(b, s, min(e - s, 8))
                blocks = [(s, e)] if k == SIMPLE_BLOCK else [(i, j) for x, i, j in _elements(b, s, e) if x == BLOCK] if k == BLOCK_GROUP else []
                for i, j in blocks:
                    number, i = _vint(b, i, j)
                    if number is None or number != track or i + 3 > j:
                        continue
                    first = (time + _signed(_be(b, i, 2), 16)) * scale - delay
                    for n, frame in enumerate(_laced(b, i + 3, j, b[i + 2] >> 1 & 3)):
                        yield first + n * step, frame
        at = stop


def _boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes between two places, a last one cut at the end."""
    while at + 8 <= end:
        size, head = _be(b, at, 4), 8
        if size == 1:
            size, head = _be(b, at + 8, 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield b[at + 4 : at + 8], min(at + head, end), min(at + size, end)
        at += size


def _tree(b: bytes, at: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    found: dict[bytes, list[tuple[int, int]]] = {}
    for kind, s, e in _boxes(b, at, end):
        found.setdefault(kind, []).append((s, e))
    return found


def _one(b: bytes, places: tuple[int, int], *kinds: bytes) -> tuple[int, int]:
    """The first box by a path of types; an empty place where there is none."""
    for kind in kinds:
        places = _tree(b, *places).get(kind, [(0, 0)])[0]
    return places


def _table(b: bytes, place: tuple[int, int], width: int, skip: int = 4) -> list[tuple[int, ...]]:
    """Rows of 32-bit numbers after version, flags and a count, as far as the box goes."""
    s, e = place
    n = min(_be(b, s + skip, 4), max(e - s - skip - 4, 0) // (4 * width))
    return [tuple(_be(b, s + skip + 4 + 4 * (i * width + j), 4) for j in range(width)) for i in range(n)]


def _shift(b: bytes, trak: tuple[int, int], rate: int, movie: int) -> int:
    """What the edit list adds to times, in the track's units: empty edits, less the start of the first that is not."""
    s, e = _one(b, trak, b"edts", b"elst")
    long, empty = (b[s] if s < e else 0) == 1, 0
    row = 20 if long else 12
    for i in range(min(_be(b, s + 4, 4), max(e - s - 8, 0) // row)):
        at, n = s + 8 + i * row, 8 if long else 4
        start = _signed(_be(b, at + n, n), 8 * n)
        if start >= 0:
            return empty - start
        empty += _be(b, at, n) * rate // movie if movie else 0
    return 0


def _samples(b: bytes, stbl: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """(time, place, size) of the samples of a table."""
    part = {k: v[0] for k, v in _tree(b, *stbl).items()}
    none = (0, 0)
    s, e = part.get(b"stsz", none)
    every, count = _be(b, s + 4, 4), _be(b, s + 8, 4)
    sizes = [every] * min(count, len(b)) if every else [x for (x,) in _table(b, part.get(b"stsz", none), 1, 8)]
    chunks = [x for (x,) in _table(b, part.get(b"stco", none), 1)] or [x << 32 | y for x, y in _table(b, part.get(b"co64", none), 2)]
    runs = _table(b, part.get(b"stsc", none), 3)
    steps = iter([(n, d) for n, d in _table(b, part.get(b"stts", none), 2) if n])
    left, step, time, i, run = 0, 0, 0, 0, -1
    for c, place in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= c:
            run += 1
        for _ in range(runs[run][1] if run >= 0 else 0):
            if i >= len(sizes):
                return
            if not left:
                left, step = next(steps, (len(sizes), step))
            yield time, place, sizes[i]
            time, place, left, i = time + step, place + sizes[i], left - 1, i + 1


def _fragment(b: bytes, moof: tuple[int, int], place: int, track: int, defaults: tuple[int, int], clock: int) -> Iterator[tuple[int, int, int]]:
    """(time, place, size) of the samples of a track in a fragment that begins at place; clock is the time where the fragment tells none."""
    for traf in _tree(b, *moof).get(b"traf", []):
        s, e = _one(b, traf, b"tfhd")
        if s == e or _be(b, s + 4, 4) != track:
            continue
        flags, at = _be(b, s + 1, 3), s + 8
        base, (duration, size) = place, defaults
        for bit, n in ((1, 8), (2, 4), (8, 4), (16, 4)):
            if flags & bit:
                x, at = _be(b, at, n), at + n
                base, duration, size = (x if bit == 1 else base), (x if bit == 8 else duration), (x if bit == 16 else size)
        s, e = _one(b, traf, b"tfdt")
        time = _be(b, s + 4, 8 if b[s] else 4) if s < e else clock
        where = base
        for s, e in _tree(b, *traf).get(b"trun", []):
            flags, at = _be(b, s + 1, 3), s + 8
            if flags & 1:
                where, at = base + _signed(_be(b, at, 4), 32), at + 4
            at += 4 if flags & 4 else 0
            row = 4 * sum(bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800))
            for _ in range(min(_be(b, s + 4, 4), max(e - at, 0) // row if row else len(b))):
                d = _be(b, at, 4) if flags & 0x100 else duration
                n = _be(b, at + (4 if flags & 0x100 else 0), 4) if flags & 0x200 else size
                if where < 0 or where + n > len(b) or not n:
                    return
                yield time, where, n
                time, where, at = time + d, where + n, at + row


def mp4(b: bytes) -> Iterator[Packet]:
    """Samples of the sample tables, then those of fragments; edit lists shift times."""
    top = list(_boxes(b, 0, len(b)))
    moov = next(((s, e) for k, s, e in top if k == b"moov"), (0, 0))
    s, e = _one(b, moov, b"mvhd")
    movie = _be(b, s + (20 if s < e and b[s] else 12), 4)
    for trak in _tree(b, *moov).get(b"trak", []):
        hdlr, _ = _one(b, trak, b"mdia", b"hdlr")
        if b[hdlr + 8 : hdlr + 12] == b"soun":
            break
    else:
        return
    s, e = _one(b, trak, b"mdia", b"mdhd")
    rate = _be(b, s + (20 if s < e and b[s] else 12), 4)
    if not rate:
        return
    shift = _shift(b, trak, rate, movie)
    end = 0
    for time, place, size in _samples(b, _one(b, trak, b"mdia", b"minf", b"stbl")):
        if place + size <= len(b):
            yield (time + shift) * NS // rate, b[place : place + size]
    s, e = _one(b, trak, b"tkhd")
    track = _be(b, s + (20 if s < e and b[s] else 12), 4)
    defaults = (0, 0)
    for s, e in _tree(b, *_one(b, moov, b"mvex")).get(b"trex", []):
        if _be(b, s + 4, 4) == track:
            defaults = _be(b, s + 12, 4), _be(b, s + 16, 4)
    for kind, s, e in top:
        if kind == b"moof":
            for time, place, size in _fragment(b, (s, e), s - 8, track, defaults, end):
                end = time + defaults[0]
                yield (time + shift) * NS // rate, b[place : place + size]


# MPEG transport: stream types of audio, and descriptors that make private data audio (fixed values)
AUDIO_TYPES = {0x03, 0x04, 0x0F, 0x11, 0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87}
AUDIO_DESCRIPTORS = {0x6A, 0x7A, 0x7B, 0x7C}
CLOCK, WRAP = 90_000, 1 << 33


def _audio_pid(pmt: bytes) -> int | None:
    """The packet id of the first audio stream of a programme map section."""
    end = 3 + (_be(pmt, 1, 2) & 0xFFF) - 4
    at = 12 + (_be(pmt, 10, 2) & 0xFFF)
    while at + 5 <= min(end, len(pmt)):
        kind, pid, n = pmt[at], _be(pmt, at + 1, 2) & 0x1FFF, _be(pmt, at + 3, 2) & 0xFFF
        tags, i = set(), at + 5
        while i + 2 <= min(at + 5 + n, len(pmt)):
            tags.add(pmt[i])
            i += 2 + pmt[i + 1]
        if kind in AUDIO_TYPES or kind == 6 and tags & AUDIO_DESCRIPTORS:
            return pid
        at += 5 + n
    return None


def mpegts(b: bytes) -> Iterator[Packet]:
    """Payloads of packets with a time stamp of their own; the clock of 33 bits goes on around the first stamp."""
    size = 192 if len(b) > 4 + 192 and b[4] == b[196] == 0x47 and b[0] != 0x47 else 188
    at = 4 if size == 192 else 0
    maps: set[int] = set()
    audio = first = None
    held: tuple[int, bytearray] | None = None
    while at + 188 <= len(b):
        if b[at] != 0x47:
            at = b.find(b"\x47", at + 1)
            while 0 <= at < len(b) - size and b[at + size] != 0x47:
                at = b.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        p = b[at : at + 188]
        at += size
        pid, begins, control = _be(p, 1, 2) & 0x1FFF, bool(p[1] & 0x40), p[3] >> 4 & 3
        if p[1] & 0x80 or not control & 1:
            continue
        body = p[5 + p[4] :] if control & 2 else p[4:]
        if begins and body and (pid == 0 or pid in maps):
            section = body[1 + body[0] :]
            if pid == 0:
                rows = range(8, min(3 + (_be(section, 1, 2) & 0xFFF) - 4, len(section) - 3), 4)
                maps |= {_be(section, i + 2, 2) & 0x1FFF for i in rows if _be(section, i, 2)}
            elif audio is None:
                audio = _audio_pid(section)
        elif pid == audio and audio is not None:
            if begins:
                if held:
                    yield held[0], bytes(held[1])
                held = None
                if body[:3] == b"\0\0\1" and len(body) >= 14 and body[7] & 0x80:
                    x = (body[9] >> 1 & 7) << 30 | (_be(body, 10, 2) >> 1) << 15 | _be(body, 12, 2) >> 1
                    first = x if first is None else first
                    x = first + (x - first + WRAP // 2) % WRAP - WRAP // 2
                    held = (x * NS // CLOCK, bytearray(body[9 + body[8] :]))
            elif held:
                held[1].extend(body)
    if held:
        yield held[0], bytes(held[1])


def _chunks(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of chunks, those of lists among them; a chunk that does not fit ends them."""
    todo = [(at, end)]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = b[at : at + 4], _le(b, at + 4, 4)
            stop = at + 8 + size
            if kind in (b"RIFF", b"LIST"):
                todo.append((stop + (size & 1), end))
                at, end = at + 12, min(stop, end)
                continue
            if stop > end:
                break
            yield kind, at + 8, stop
            at = stop + (size & 1)


def avi(b: bytes) -> Iterator[Packet]:
    """Chunks of the first audio stream through all segments of the file; times by bytes where samples have a size, else by chunks."""
    stream, found, scale, rate, sample, start = -1, None, 0, 0, 0, 0
    seen = 0
    for kind, s, e in _chunks(b, 0, len(b)):
        if kind == b"strh":
            stream += 1
            if b[s : s + 4] == b"auds" and found is None:
                found, scale, rate, start, sample = stream, _le(b, s + 20, 4), _le(b, s + 24, 4), _le(b, s + 28, 4), _le(b, s + 44, 4)
        elif found is not None and kind == b"%02dwb" % found and rate:
            units = seen // sample if sample else seen
            yield (start + units) * scale * NS // rate, b[s:e]
            seen += e - s if sample else 1


READERS = {"matroska": matroska, "mp4": mp4, "mpegts": mpegts, "avi": avi}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def packets(media: DataFrame) -> DataFrame:
    """PACKETS of the first audio track of each file (path, content); files of other kinds, empty and null ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                rows = [(path, kind, n, time, data) for n, (time, data) in enumerate(READERS[kind](bytes(content)))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "container", "n", "time_ns", "data"])

    known = media.select("path", m.container(F.substring("content", 1, 200)).alias("kind"), "content").where(F.col("kind").isin(*READERS))
    return known.mapInPandas(run, PACKETS)
