"""Vectorised words, shingles and minhashes over Arrow string buffers.

Works on the UTF-8 bytes of a batch without making Python strings. Words are
64-bit hashes of their bytes; shingles are 64-bit hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; a longer word makes its piece longer.
PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(n, base, _U)
            x[0] = 1
            tables.append(np.cumprod(x))
        if n > 8 * PIECE:
            return tables
        _powers = tables
    return _powers


def placed_words(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of one text (bytes), with A-Z in lower case, and where they start."""
    if len(data) <= PIECE:
        return _spans(data, separators, None)
    found, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not separators[data[end]]:
            stop = np.flatnonzero(separators[data[end : end + PIECE]])
            end = end + int(stop[0]) if len(stop) else min(end + PIECE, len(data))
        hashes, first = _spans(data[at:end], separators, None)
        found.append(hashes)
        starts.append(first + at)
        at = end
    return np.concatenate(found), np.concatenate(starts)


def word_hashes(data: np.ndarray, separators: np.ndarray = SPACE) -> np.ndarray:
    """The hashes of the words of one text (bytes), with A-Z in lower case."""
    return placed_words(data, separators)[0]


def _spans(data: np.ndarray, separators: np.ndarray, breaks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words; a word also ends at breaks."""
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if breaks is not None:
        b = breaks[(breaks > 0) & (breaks < len(data))]
        starts[b] = inside[b]
        ends[b - 1] = inside[b - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(first):
        return np.empty(0, _U), first
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((LOWER[data].astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(_U) * _STEP), first


def batch_words(column: pa.Array, separators: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row and in all) for runs of rows of a string column; null rows have none.

    A run covers at most PIECE bytes, or one row.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    valid = np.asarray(column.is_valid())
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        end = min(end, n)
        if end == row + 1:
            text = data[offsets[row] : offsets[end]] if valid[row] else data[:0]
            words = word_hashes(text, separators)
            yield row, words, np.array([0, len(words)])
        else:
            piece, local = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            words, first = _spans(piece, separators, local)
            before = np.searchsorted(first, local)
            before[-1] = len(words)
            yield row, words, before
        row = end


def shingles(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the k-word shingles of each text in order. A text of fewer words, but some, has its whole sequence as one."""
    n = len(words)
    counts = np.diff(before)
    h = words.copy()
    for j in range(1, min(k, n)):
        h[: n - j] = (h[: n - j] * _MIX1) ^ words[j:]
        h[: n - j] = (h[: n - j] ^ (h[: n - j] >> _U(29))) * _STEP
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - before[:-1], size)
    out = mix(h[take] + _U(k))
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = _U(0)
        for w in words[before[i] : before[i + 1]].tolist():
            x = _U(((int(x) * int(_MIX2)) ^ w) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        out[bounds[i]] = mix(np.array([x + _U(counts[i])], _U))[0]
    return out, bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets, each in ascending order."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.searchsorted(t[new], np.arange(len(bounds)))


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(1, 2 * n + 1, dtype=_U) * _STEP
    x = mix(x)
    return x[:n], x[n:] | _U(1)


def minhashes(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """An array (sets, n) of minima; rows of empty sets hold the largest value."""
    out = np.full((len(bounds) - 1, n), np.iinfo(_U).max, _U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[full]
        for i, (a, b) in enumerate(zip(*seeds(n), strict=True)):
            x = (sets ^ a) * b
            x ^= x >> _U(32)
            x *= _MIX1
            out[full, i] = np.minimum.reduceat(x, starts)
    return out
