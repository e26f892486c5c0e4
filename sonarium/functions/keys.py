"""Identities of files and URLs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 64 * 1024

#: Query parameters that carry credentials or expiry.
VOLATILE = """
token access_token auth key sig signature expires exp
policy key-pair-id x-amz-signature x-amz-credential x-amz-date
x-amz-expires x-amz-security-token x-amz-algorithm x-amz-signedheaders
""".split()

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def opaque(x: Column) -> Column:
    return F.concat(F.lit("id:"), F.substring(F.sha2(x, 256), 1, 32))


def content(size: Column, head: Column, tail: Column) -> Column:
    """From the size and the first and last EDGE bytes: size as 8 bytes, little-endian."""
    le = F.unhex(F.concat(*(F.substring(F.lpad(F.hex(size), 16, "0"), 15 - 2 * i, 2) for i in range(8))))
    return F.concat(F.lit("c:"), F.sha2(F.concat(le, head, tail), 256))


def storable(key: Column) -> Column:
    return key.rlike("^(ih|c|id):")


#: The base32 alphabet of RFC 4648, and the digits that conv() has for it.
BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_HASH = "(?:[0-9a-fA-F]{40}|[a-zA-Z2-7]{32})"


def _converted(text: Column, base: int, width: int, to: int, to_width: int, times: tuple[int, ...]) -> Column:
    """text in another base, by groups of at most 60 bits: of width digits to to_width ones, each so many times as given."""
    at, parts = 1, []
    for n in times:
        parts.append(F.lpad(F.conv(F.substring(text, at, width * n), base, to), to_width * n, "0"))
        at += width * n
    return F.concat(*parts)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once. Generated code only calls it, so its methods stay small enough to be compiled (8000 bytes)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits."""
    return _let(hex_digits, lambda h: F.translate(_converted(h, 16, 5, 32, 4, (3, 3, 2)), _DIGITS, BASE32))


def infohash(text: Column) -> Column:
    """The 40 hex digits in lower case of an infohash in hex or base32; null for others."""
    of_base32 = lambda digits: F.lower(_converted(digits, 32, 4, 16, 5, (3, 3, 2)))
    return _let(text, lambda t: F.when(t.rlike("^[0-9a-fA-F]{40}$"), F.lower(t)).when(t.rlike("^[a-zA-Z2-7]{32}$"), _let(F.translate(F.upper(t), BASE32, _DIGITS), of_base32)))


def torrent(infohash_: Column, index: Column) -> Column:
    """Infohashes in hex or base32 become lower-case hex, others stay as they are; no index is the first."""
    key = lambda h: F.concat(F.lit("ih:"), F.coalesce(infohash(h), h), F.lit("/"), F.coalesce(F.nullif(index, F.lit("")), F.lit("1")))
    return _let(infohash_, lambda h: F.when(F.coalesce(h, F.lit("")) == "", F.lit("")).otherwise(key(h)))


def stream_key(url: Column) -> Column:
    """The torrent key that a stream URL names (/play/HASH/N, or /stream?link=HASH&index=N, the link a hash or a magnet link with one); else empty."""
    play = rf"/play/({_HASH})/([^/?#]+)/?(?:[?#].*)?$"

    def of_link(link: Column, n: Column) -> Column:
        magnet = F.nullif(F.regexp_extract(F.url_decode(link), rf"urn:btih:({_HASH})(?:[^0-9a-zA-Z]|$)", 1), F.lit(""))
        return _let(F.coalesce(magnet, link), lambda x: F.when(x.rlike(f"^{_HASH}$"), torrent(x, n)).otherwise(F.lit("")))

    def of_query(u: Column, query: Column) -> Column:
        n = F.regexp_extract(query, r"(?:^|&)index=([^&]*)", 1)
        is_stream = F.regexp_extract(u, _URL, 3).rlike("^/stream(/|$)") & (n != "")
        return F.when(is_stream, of_link(F.regexp_extract(query, r"(?:^|&)link=([^&]*)", 1), n)).otherwise(F.lit(""))

    def key(u: Column) -> Column:
        stream = _let(F.regexp_extract(u, _URL, 4), lambda q: of_query(u, q))
        return _let(F.regexp_extract(u, play, 1), lambda h: F.when(h != "", torrent(h, F.regexp_extract(u, play, 2))).otherwise(stream))

    return _let(url, key)


def _parameters(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: p != "")


def _name(p: Column) -> Column:
    return F.lower(F.substring_index(p, "=", 1))


def _named(p: Column) -> Column:
    """A parameter with its equals sign, which one without a value also gets."""
    return F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("=")))


def _rebuilt(url: Column, authority: Column, query: Column, fragment: Column) -> Column:
    path = F.regexp_extract(url, _URL, 3)
    whole = F.concat(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("://"), authority, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)), fragment)
    return F.when(url.rlike(_URL), whole).otherwise(url)


def normalised_url(url: Column) -> Column:
    """Without user, fragment and volatile parameters; the others in order of their names; the host in lower case."""
    kept = F.filter(_parameters(url), lambda p: ~_name(p).isin(VOLATILE))
    by_name = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("n"), i.alias("i"), _named(p).alias("p")))), lambda s: s["p"])
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 2), "^.*@", ""))
    return _rebuilt(url, host, F.array_join(by_name, "&"), F.lit(""))


def redacted_url(url: Column) -> Column:
    """For logs: volatile values hidden, the password masked; parameters in order of their names."""
    hidden = F.transform(_parameters(url), lambda p: F.when(_name(p).isin(VOLATILE), F.concat(F.substring_index(p, "=", 1), F.lit("=REDACTED"))).otherwise(_named(p)))
    by_name = F.transform(F.array_sort(F.transform(hidden, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("n"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    who = F.regexp_replace(F.regexp_extract(url, _URL, 2), "^([^:@]*):[^@]*@", "$1:xxxxx@")
    fragment = F.regexp_extract(url, _URL, 5)
    return _rebuilt(url, who, F.array_join(by_name, "&"), F.when(fragment == "", F.lit("")).otherwise(F.concat(F.lit("#"), fragment)))
