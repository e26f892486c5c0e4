"""Media time and the texts that show it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
INT_MAX, INT_MIN = (1 << 31) - 1, -(1 << 31)
#: Boxes that can start an MP4 or QuickTime file.
BOXES = "ftyp styp moov mdat wide free skip".split()
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def ticks(t: Column, num: Column, den: Column) -> Column:
    """t num / den seconds in nanoseconds, exact, halves away from zero, kept within 64 bits; 0 for den 0. t num up to 10^28."""
    wide = lambda x: x.cast("decimal(38,0)")
    n = F.abs(wide(wide(t) * wide(num)) * F.lit(NS).cast("decimal(10,0)"))
    n = wide(n)
    d = wide(F.abs(den))
    whole = wide(F.floor((n - F.pmod(n, d)) / d))
    rest = F.pmod(n, d)
    rounded = wide(whole + F.when(rest * 2 >= d, 1).otherwise(0))
    negative = (F.signum(t.cast("double")) * F.signum(num.cast("double")) * F.signum(den.cast("double"))) < 0
    signed = F.when(negative, -rounded).otherwise(rounded)
    held = F.least(F.greatest(wide(signed), F.lit(LONG_MIN).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
    return F.when(den == 0, F.lit(0)).otherwise(held.cast("long"))


def to_ms(ns: Column) -> Column:
    """Nanoseconds to milliseconds, halves away from zero, within 32 bits."""
    whole = F.floor((F.abs(ns) + 500_000) / F.lit(1_000_000)).cast("long")
    return F.least(F.greatest(F.when(ns < 0, -whole).otherwise(whole), F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int")


def sample_count(ns: Column, rate: int = 8000) -> Column:
    return F.floor((ns * rate + NS // 2) / F.lit(NS)).cast("long")


def position(ms: Column) -> Column:
    """h:mm:ss or m:ss."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def label_or_default(label: Column, kind: Column, hex_id: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(kind, F.lit("-"), F.substring(hex_id, 1, 8)))


def total_size(content_range: Column) -> Column:
    """The total of a Content-Range field; null if it is unknown."""
    return F.nullif(F.regexp_extract(content_range, r"^bytes .*/([0-9]+)$", 1), F.lit("")).cast("long")


def container(head: Column) -> Column:
    """avi, matroska, mp4, mpegts, mp3 or empty, from the first bytes of a file."""
    h = F.hex(head)
    at = lambda i, n: F.substring(h, 2 * i + 1, 2 * n)
    return (
        F.when(F.length(h) < 32, "")
        .when((at(0, 4) == "52494646") & (at(8, 4) == "41564920"), "avi")
        .when(at(0, 4) == "1A45DFA3", "matroska")
        .when(at(4, 4).isin(*(b.encode().hex().upper() for b in BOXES)), "mp4")
        .when((at(0, 1) == "47") & (at(188, 1) == "47"), "mpegts")
        .when((at(4, 1) == "47") & (at(196, 1) == "47"), "mpegts")
        .when(((at(0, 2) == "FFFA") | (at(0, 2) == "FFFB")) | (at(0, 3) == "494433"), "mp3")
        .otherwise("")
    )
