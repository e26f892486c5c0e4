"""Queries of media containers: pages are packed into files of each kind, whose packets are read again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..sources import containers as c
from .fixtures import tables

QUERIES, ORACLE = {}, {}

#: Bytes of a packet, and milliseconds from one to the next.
SIZE, STEP = 1000, 20
#: The first time stamp of transport streams: the clock wraps a second later.
FIRST_STAMP = c.WRAP - c.CLOCK


def _u(n: int, *values: int) -> bytes:
    return b"".join(v.to_bytes(n, "big") for v in values)


def _l(n: int, *values: int) -> bytes:
    return b"".join(v.to_bytes(n, "little") for v in values)


def _element(key: int, body: bytes, size: bool = True) -> bytes:
    """An element, its size of eight bytes or not told."""
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + (_u(8, 1 << 56 | len(body)) if size else b"\x01" + b"\xff" * 7) + body


def _number(key: int, value: int) -> bytes:
    return _element(key, _u(8, value))


def matroska(parts: list[bytes]) -> bytes:
    """Clusters of six packets: in turn one block of each, blocks of three laced by differences, by sizes in steps, and in groups."""
    tracks = _element(c.TRACK, _number(c.TRACK_NUMBER, 1) + _number(c.TRACK_TYPE, 1))
    tracks += _element(c.TRACK, _number(c.TRACK_NUMBER, 2) + _number(c.TRACK_TYPE, c.AUDIO) + _number(c.TRACK_DEFAULT_DURATION, STEP * 1_000_000) + _number(c.CODEC_DELAY, 5_000_000))
    body = _element(c.INFO, _number(c.SCALE, 1_000_000)) + _element(c.TRACKS, tracks)
    for at in range(0, len(parts), 6):
        cluster = _number(c.TIME, at * STEP) + _element(c.SIMPLE_BLOCK, b"\x81\0\0\x80picture")
        mode = at // 6 % 4
        group = parts[at : at + 6]
        for i in range(0, len(group), 1 if mode in (0, 3) else 3):
            frames = group[i : i + 3] if mode in (1, 2) else group[i : i + 1]
            head = b"\x82" + (i * STEP + 5).to_bytes(2, "big", signed=True)
            if mode == 1:  # xiph
                sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
                cluster += _element(c.SIMPLE_BLOCK, head + b"\x82" + bytes([len(frames) - 1]) + sizes + b"".join(frames))
            elif mode == 2:  # differences, of four bytes
                lace = b"".join(_u(4, 1 << 28 | (len(f) if j == 0 else len(f) - len(frames[j - 1]) + (1 << 27) - 1)) for j, f in enumerate(frames[:-1]))
                cluster += _element(c.SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames))
            else:
                block = head + b"\0" + frames[0]
                cluster += _element(c.SIMPLE_BLOCK, block) if mode == 0 else _element(c.BLOCK_GROUP, _element(c.BLOCK, block))
        body += _element(c.CLUSTER, cluster, size=mode != 3)
    return _element(0x1A45DFA3, _element(0x4282, b"matroska")) + _element(c.SEGMENT, body, size=False)


def _box(kind: bytes, *body: bytes) -> bytes:
    return _u(4, 8 + sum(map(len, body))) + kind + b"".join(body)


def _moov(tables_: bytes, edits: bytes, more: bytes = b"") -> bytes:
    mvhd = _box(b"mvhd", _u(4, 0, 0, 0, 1000, 0), bytes(80))
    video = _box(b"trak", _box(b"tkhd", _u(4, 0, 0, 0, 1), bytes(68)), _box(b"mdia", _box(b"hdlr", _u(4, 0, 0), b"vide", bytes(13))))
    mdia = _box(b"mdia", _box(b"mdhd", _u(4, 0, 0, 0, 48_000, 0, 0)), _box(b"hdlr", _u(4, 0, 0), b"soun", bytes(13)), _box(b"minf", _box(b"stbl", tables_)))
    return _box(b"moov", mvhd, video, _box(b"trak", _box(b"tkhd", _u(4, 0, 0, 0, 2), bytes(68)), edits, mdia), more)


def mp4(parts: list[bytes]) -> bytes:
    """Sample tables with chunks of four packets; an empty edit of 20 ms and 960 units of priming cancel out."""
    edits = _box(b"edts", _box(b"elst", _u(4, 0, 2, STEP, 0xFFFFFFFF, 0x10000, 1000, 960, 0x10000)))
    head = _box(b"ftyp", b"isom", _u(4, 512))
    chunks = [parts[i : i + 4] for i in range(0, len(parts), 4)]
    place, places = len(head) + 8, []
    data = b""
    for chunk in chunks:
        places.append(place + len(data))
        data += b"".join(chunk) + b"gap"
    runs = [(1, 4, 1)] + ([(len(chunks), len(chunks[-1]), 1)] if len(chunks) > 1 else [])
    runs = runs if len(chunks) > 1 else [(1, len(parts), 1)]
    stbl = _box(b"stts", _u(4, 0, 1, len(parts), 960)) + _box(b"stsc", _u(4, 0, len(runs)), *(_u(4, *r) for r in runs))
    stbl += _box(b"stsz", _u(4, 0, 0, len(parts), *map(len, parts))) + _box(b"stco", _u(4, 0, len(places), *places))
    return head + _box(b"mdat", data) + _moov(stbl, edits)


def mp4_fragments(parts: list[bytes]) -> bytes:
    """Fragments of five packets, every other with its sizes and durations told one by one."""
    trex = _box(b"mvex", _box(b"trex", _u(4, 0, 2, 1, 960, 0, 0)))
    out = _box(b"ftyp", b"iso5", _u(4, 512)) + _moov(b"", b"", trex)
    for at in range(0, len(parts), 5):
        group = parts[at : at + 5]
        same = len({len(p) for p in group}) == 1 and at % 2 == 0
        tfhd = _box(b"tfhd", _u(4, 0x020010 if same else 0x020000, 2), _u(4, len(group[0])) if same else b"")
        tfdt = _box(b"tfdt", _u(4, 1 << 24), _u(8, at * 960))
        rows = b"" if same else b"".join(_u(4, 960, len(p)) for p in group)
        moof = lambda where: _box(b"moof", _box(b"mfhd", _u(4, 0, at)), _box(b"traf", tfhd, tfdt, _box(b"trun", _u(4, 1 if same else 0x301, len(group), where), rows)))
        out += moof(len(moof(0)) + 8) + _box(b"mdat", b"".join(group))
    return out


def _ts_packets(pid: int, body: bytes) -> bytes:
    """A section or a time-stamped unit as packets, the last filled up by an adaptation field."""
    out, begins = b"", True
    while body or begins:
        part, body = body[:184], body[184:]
        fill = 184 - len(part)
        field = b"" if not fill else b"\0" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
        out += b"\x47" + _u(2, (0x4000 if begins else 0) | pid) + bytes([0x30 if fill else 0x10]) + field + part
        begins = False
    return out


def mpegts(parts: list[bytes]) -> bytes:
    """A programme with pictures and sound; the clock wraps after a second."""
    section = lambda table, body: bytes([0, table]) + _u(2, 0xB000 | len(body) + 4) + body + bytes(4)
    out = _ts_packets(0, section(0, _u(2, 1) + b"\xc1\0\0" + _u(2, 1, 0xE100)))
    out += _ts_packets(0x100, section(2, _u(2, 1) + b"\xc1\0\0" + _u(2, 0xE101, 0xF000) + b"\x1b" + _u(2, 0xE101, 0xF000) + b"\x06" + _u(2, 0xE102, 0xF003) + b"\x6a\x01\0"))
    for n, part in enumerate(parts):
        t = (FIRST_STAMP + n * STEP * c.CLOCK // 1000) % c.WRAP
        stamp = bytes([0x21 | t >> 30 << 1]) + _u(2, (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)
        out += _ts_packets(0x101, b"\0\0\1\xe0\0\0\x80\0\0picture") + _ts_packets(0x102, b"\0\0\1\xbd\0\0\x80\x80\x05" + stamp + part)
    return out


def avi(parts: list[bytes]) -> bytes:
    """Two segments; sound is the second stream, some of it in record lists."""
    chunk = lambda kind, body: kind + _l(4, len(body)) + body + b"\0" * (len(body) & 1)
    listed = lambda kind, body, of=b"LIST": of + _l(4, len(body) + 4) + kind + body
    stream = lambda kind, scale, rate: listed(b"strl", chunk(b"strh", kind + bytes(16) + _l(4, scale, rate, 0, 0, 0, 0, 0) + bytes(8)))
    sound = lambda ps: b"".join(chunk(b"00dc", b"picture") + (listed(b"rec ", chunk(b"01wb", p)) if i % 3 == 0 else chunk(b"01wb", p)) for i, p in enumerate(ps))
    half = len(parts) // 2
    hdrl = listed(b"hdrl", stream(b"vids", 1, 25) + stream(b"auds", STEP, 1000))
    return listed(b"AVI ", hdrl + listed(b"movi", sound(parts[:half])), b"RIFF") + listed(b"AVIX", listed(b"movi", sound(parts[half:])), b"RIFF")


def _query(key: str, write: Callable[[int, list[bytes]], bytes], time: str) -> None:
    def run(spark, sf):
        """Packets of each page's file: when, and what."""

        def packed(batches):
            for b in batches:
                raw = [str(x or "").encode() for x in b["html"]]
                yield pd.DataFrame({"path": b["page_id"].astype(str), "content": [write(int(i), [x[at : at + SIZE] for at in range(0, len(x), SIZE)]) for i, x in zip(b["page_id"], raw, strict=True)]})

        media = tables(spark, sf, "pages")[0].select("page_id", "html").mapInPandas(packed, "path string, content binary")
        return c.packets(media).select(F.col("path").cast("long").alias("page_id"), "n", F.floor(F.col("time_ns") / 1_000_000).alias("time_ms"), F.sha2("data", 256).alias("digest"))

    QUERIES[key] = run
    ORACLE[key] = f"SELECT page_id, n, {time} AS time_ms, sha256(b[n * {SIZE} + 1 : (n + 1) * {SIZE}]) AS digest FROM (SELECT page_id, b, unnest(range(0, (octet_length(b) + {SIZE - 1}) // {SIZE})) AS n FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages))"


_query("S15", lambda i, parts: matroska(parts), f"n * {STEP}")
_query("S16", lambda i, parts: mp4(parts) if i % 2 else mp4_fragments(parts), f"n * {STEP}")
_query("S17", lambda i, parts: mpegts(parts), f"({FIRST_STAMP} + n * {STEP * c.CLOCK // 1000}) // 90")
_query("S18", lambda i, parts: avi(parts), f"n * {STEP}")
