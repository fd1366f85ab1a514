"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

Words are runs of bytes other than space and 0x09-0x0D.  A word's 64-bit
hash is a polynomial over a fixed random table of byte values, taken from
prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``, kept and extended as needed."""
    have = len(_POWERS[0])
    if n >= have:
        size = (n // (1 << 18) + 1) << 18
        for k, base in enumerate((_BASE, _INVERSE)):
            more = np.full(size, base, U64)
            more[0] = 1
            _POWERS[k] = np.cumprod(more, dtype=U64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` takes the hash of any slice."""
    sums = np.zeros(len(data) + 1, U64)
    _, down = powers(len(data))
    weighted = _VALUES[data]
    weighted *= down[: len(data)]
    np.cumsum(weighted, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, _ = powers(len(sums) - 1)
    # position-free: multiply by BASE**start undoes the INVERSE**start of the slice's first byte
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more entry at the end)."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = solid[begin]
    last[end] = solid[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(prefix_hashes(data), starts, ends), starts, ends, bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = (out + words[i : i + n]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(32)
    return mix(out)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words has its whole sequence as one, without words none."""
    every = shingle_hashes(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(shingle_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each slice, one slice after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
