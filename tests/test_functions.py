"""Codecs, keys, media time, signatures and the fingerprint kernel against plain versions."""

import base64
import hashlib
import random
from fractions import Fraction
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonarium.functions import codec, ed25519, fingerprint, keys, media


@given(st.lists(st.tuples(st.integers(0, (1 << 24) - 1), st.integers(0, 20_000)), max_size=60))
def test_landmarks_round_trip(points):
    assert codec.decode(codec.encode(points)) == sorted(points, key=lambda p: (p[1], p[0]))


@pytest.mark.parametrize("bad", [b"\x80\x00\x01abc", b"\x01\x00", b"\x01\x02abc", b"\x00\x01abc\x00\x01abc", b"\x00\x02\x02\x00\x00\x01\x00\x00"])
def test_only_the_canonical_form_is_read(bad):
    with pytest.raises(codec.Corrupt):
        codec.decode(bad)


def test_content_id(spark):
    blob = codec.encode([(5, 1), (7, 1), (3, 9)])
    got = spark.createDataFrame([(bytearray(blob),)], "b binary").select(codec.content_id(F.col("b")).alias("i")).first().i
    assert bytes(got) == hashlib.sha256(b"\x01\0\0\0" + blob).digest()[:16]


@given(st.lists(st.tuples(st.sampled_from(["ad.add", "x"]), st.integers(1, 1 << 40), st.integers(-(1 << 40), 1 << 40), st.binary(max_size=40)), max_size=5))
def test_frames_round_trip(rows):
    records = [codec.Record(k, bytes(32), s, t, b, bytes(64)) for k, s, t, b in rows]
    assert list(codec.frames(b"".join(map(codec.frame, records)))) == records


def test_cut_frames_are_corrupt():
    whole = codec.frame(codec.Record("ad.add", bytes(32), 1, 2, b"{}", bytes(64)))
    for n in range(1, len(whole)):
        with pytest.raises(codec.Corrupt):
            list(codec.frames(whole[:n]))


def plain_ticks(t, n, d):
    """t * n / d seconds in nanoseconds, halves away from zero, within 64 bits."""
    if not d:
        return 0
    x = Fraction(t * n * 10**9, d)
    whole = int(abs(x) + Fraction(1, 2)) * (1 if x >= 0 else -1)
    return max(-media.LONG_MAX - 1, min(media.LONG_MAX, whole))


def test_ticks(spark):
    rng = random.Random(5)
    cases = [(rng.randrange(-(1 << k), 1 << k), rng.choice([1, 7, 1000, 1001]), rng.choice([0, 1, 3, 25, 48_000, 90_000, 1 << 30])) for k in (4, 20, 33, 50) for _ in range(12)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, t long, n long, d long")
    got = {r.i: r.x for r in df.select("i", media.ticks(F.col("t"), F.col("n"), F.col("d")).alias("x")).collect()}
    assert got == {i: plain_ticks(*c) for i, c in enumerate(cases)}
    times = [2_499_999, 2_500_000, -2_500_000, 7, 1 << 61]
    ms = spark.createDataFrame([(x,) for x in times], "n long").select(media.to_ms(F.col("n")).alias("m"))
    assert [r.m for r in ms.collect()] == [min(media.INT_MAX, plain_ticks(x, 1, 10**15)) for x in times]


def plain_url(url, hide):
    """A URL without user, fragment and volatile parameters, or (hide) with these hidden."""
    u = urlsplit(url)
    host = u.netloc if hide else u.netloc.rpartition("@")[2].lower()
    if hide and "@" in host:
        user, _, rest = host.partition("@")
        host = f"{user.split(':')[0]}:xxxxx@{rest}" if ":" in user else host
    kept = [(p.split("=")[0], p if "=" in p else p + "=") for p in u.query.split("&") if p]
    if hide:
        kept = [(n, f"{n}=REDACTED" if n.lower() in keys.VOLATILE else p) for n, p in kept]
    else:
        kept = [(n, p) for n, p in kept if n.lower() not in keys.VOLATILE]
    query = "&".join(p for _, p in sorted(kept, key=lambda x: x[0]))
    return f"{u.scheme.lower()}://{host}{u.path}" + (f"?{query}" if query else "") + (f"#{u.fragment}" if hide and u.fragment else "")


def test_urls(spark):
    rng = random.Random(6)
    urls = []
    for i in range(40):
        params = [rng.choice(["q=ä", "page=2", "Sig=zz", "EXPIRES=1", "lang", "key=k", "z=", "b=%20"]) for _ in range(rng.randrange(4))]
        urls.append(f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'ann@', 'ann:secret@'])}Video.Example:81/f{i}.mp4" + ("?" + "&".join(params) if params else "") + rng.choice(["", "#part"]))
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", keys.normalised_url(F.col("u")).alias("n"), keys.redacted_url(F.col("u")).alias("r"))
    for r in df.collect():
        assert (r.n, r.r) == (plain_url(r.u, False), plain_url(r.u, True))


def test_torrent_keys(spark):
    rng = random.Random(7)
    for raw in (rng.randbytes(20) for _ in range(5)):
        h, b32 = raw.hex(), base64.b32encode(raw).decode()
        cases = {f"http://h/x/play/{h.upper()}/4": f"ih:{h}/4", f"http://h/play/{b32}/4": f"ih:{h}/4", f"http://h/stream/a.mkv?link={b32.lower()}&index=9": f"ih:{h}/9", f"http://h/stream?index=1&link=magnet%3A%3Fdn%3Da%26xt%3Durn%3Abtih%3A{b32}%26tr%3Db": f"ih:{h}/1"}
        cases |= {f"http://h/stream?link={h}": "", f"http://h/play/{h[:-1]}/4": "", f"http://h/file?link={h}&index=1": "", f"http://h/stream?link={b32[:-1]}1&index=1": ""}
        got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", keys.stream_key(F.col("u")).alias("k")).collect()
        assert {r.u: r.k for r in got} == cases


def test_content_key(spark):
    rng = random.Random(8)
    for size in (0, 5, keys.EDGE, keys.EDGE + 1, 200_001):
        data = rng.randbytes(size)
        row = (size, bytearray(data[: keys.EDGE]), bytearray(data[-keys.EDGE :]))
        got = spark.createDataFrame([row], "n long, a binary, b binary").select(keys.content(F.col("n"), F.col("a"), F.col("b")).alias("k")).first().k
        assert got == "c:" + hashlib.sha256(size.to_bytes(8, "little") + data[: keys.EDGE] + data[-keys.EDGE :]).hexdigest()


def test_signatures():
    rng = random.Random(9)
    for n in (0, 1, 200):
        seed, message = rng.randbytes(32), rng.randbytes(n)
        public = ed25519.public_key(seed)
        sig = ed25519.sign(seed, public, message)
        assert ed25519.verify(public, message, sig) and not ed25519.verify(public, message + b"x", sig)
        assert not ed25519.verify(ed25519.public_key(rng.randbytes(32)), message, sig)
    # the first test vector of RFC 8032
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert ed25519.sign(seed, ed25519.public_key(seed), b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bac")


def naive_landmarks(pcm):
    spec = fingerprint.spectrogram(pcm)
    n = len(spec)
    around = np.zeros_like(spec)
    for t in range(n):
        for f in range(4, 500):
            around[t, f] = spec[t, max(0, f - 10) : f + 11].max()
    cands = [(t, f) for t in range(n) for f in range(4, 500) if spec[t, f] >= 0.5 and spec[t, f] >= around[t, f] and all(around[k, f] <= spec[t, f] for k in range(max(0, t - 3), min(n, t + 4)))]
    kept = []
    for b in {t // 31 for t, _ in cands}:
        kept += sorted((c for c in cands if c[0] // 31 == b), key=lambda c: (-spec[c], c))[:30]
    kept.sort()
    out = []
    for i, (t, f) in enumerate(kept):
        later = [(t2, f2) for t2, f2 in kept[i + 1 :] if 0 < t2 - t <= 63][:6]
        out += [((f << 15) | (f2 << 6) | (t2 - t), t) for t2, f2 in later]
    return out


def test_landmarks_equal_a_naive_kernel():
    rng = np.random.default_rng(3)
    t = np.arange(4 * 8000) / 8000
    pcm = (0.4 * np.sin(2 * np.pi * 500 * t * (1 + 0.1 * np.floor(t))) + 0.1 * rng.standard_normal(len(t))).astype(np.float32)
    h, at = fingerprint.landmarks(pcm)
    assert list(zip(h.tolist(), at.tolist(), strict=True)) == naive_landmarks(pcm)
    assert len(fingerprint.landmarks(pcm[:1000])[0]) == 0


def test_samples():
    assert fingerprint.samples(b"\x00\x80\xff\x7f\x01").tolist() == [-1.0, 32767 / 32768]
