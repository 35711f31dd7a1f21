"""Vectorised hashing of words and word windows over Arrow batches of texts.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D.  Texts arrive as binary columns
(UTF-8), are hashed in pieces of about `PIECE` bytes, so that memory does not follow the length of
a text beyond eight bytes a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_SOLID = np.ones(256, bool)
_SOLID[list(BLANKS)] = False
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUE[~_SOLID] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_POWERS = powers(_BASE, 4096)


def _hash(data: np.ndarray, firsts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, last two bytes and start of every word of `data`; a word also starts anew at each of
    `firsts`."""
    global _POWERS
    solid = _SOLID[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[firsts] = solid[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts
    lengths = np.diff(starts, append=len(data))
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = powers(_BASE, longest)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = (_VALUE_LOWER if lower else _VALUE)[data[starts[0]:]] * _POWERS[place]
    last = starts + np.add.reduceat(solid[starts[0]:], starts - starts[0], dtype=np.int64) - 1
    ends = data[last].astype(np.int64) << 8 | data[np.maximum(last - 1, starts)]
    return mix(np.add.reduceat(values, starts - starts[0])), ends, starts


def _long(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and ends of one text of any length, cut into pieces at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and _SOLID[data[end]]:
            blank = np.flatnonzero(~_SOLID[data[end:end + PIECE]])
            end = end + int(blank[0]) if len(blank) else min(len(data), end + PIECE)
        parts.append(_hash(data[at:end], np.empty(0, np.int64), lower)[:2])
        at = end
    return tuple(np.concatenate(c) for c in zip(*parts))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offs


def hashed_ends(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word ends, bounds): the words of row first+i are
    hashes[bounds[i]:bounds[i+1]], an end is a word's last two bytes."""
    raw, offs = texts(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, "right")) - 1)
        if offs[to] - offs[at] > PIECE:
            h, ends = _long(raw[offs[at]:offs[to]], lower)
            yield at, h, ends, np.array([0, len(h)])
        else:
            own = offs[at:to + 1] - offs[at]
            firsts = own[:-1][np.diff(own) > 0]
            h, ends, starts = _hash(raw[offs[at]:offs[to]], firsts, lower)
            yield at, h, ends, np.searchsorted(starts, own)
        at = to


def hashed(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds)."""
    for at, h, _, bounds in hashed_ends(column, lower):
        yield at, h, bounds


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` words (none where there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k, p in enumerate(powers(0xD1342543DE82EF95, n)):
        total += words[k:k + m] * p
    return mix(total + np.uint64(n))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The same for long runs, by prefix sums in time independent of `n` (other values)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = 0xF1357AEA2E62A9C5
    up, down = powers(base, len(words)), powers(pow(base, -1, 1 << 64), m)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mix((sums[n:] - sums[:m]) * down + np.uint64(n))
