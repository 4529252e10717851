"""Words and rolling hashes of a whole Arrow text column at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; texts never run into
each other.  Null texts count as empty.  Temporaries take about 60 bytes per
text byte, so callers pass columns of a few MB.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept for the next call."""
    if n > 1 << 22:
        return _powers.__wrapped__(base, n)
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each text begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, begin, data = column.buffers()
    offsets = np.frombuffer(begin, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes each (a longer text stands alone)."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        out.append((a, b))
        a = b
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word, and the index of each text's first word."""
    token = ~BLANK[data]
    first, last = token.copy(), token.copy()
    first[1:] &= ~token[:-1]
    last[:-1] &= ~token[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = token[inner]
    last[inner - 1] = token[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.arange(len(data), dtype=np.int64)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    at -= np.maximum.accumulate(begin)
    table = powers(WORD_BASE, int(length.max()) + 1)
    inside = ~BLANK[data]
    at[~inside] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * table[at]
    value[~inside] = 0
    # words may touch only at a text's end, so each sum runs from a word's start to the next one's
    return mix(np.add.reduceat(value, starts) + length.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def window_hashes(words: np.ndarray, begin: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``width`` consecutive words inside one text.

    ``begin`` has the index of each text's first word.  Returns the windows'
    first words and hashes; a window's hash is a polynomial in its words'
    hashes modulo 2**64, taken from prefix sums.
    """
    n = len(words)
    room = np.zeros(n, bool)
    for_text = np.diff(begin)
    left = np.repeat(begin[1:], for_text) - np.arange(n)
    room = left >= width
    at = np.flatnonzero(room)
    if len(at) == 0:
        return at, np.zeros(0, np.uint64)
    base = (WINDOW_BASE * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF | 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), dtype=np.uint64, out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return at, mix((sums[at + width] - sums[at]) * powers(inverse, n)[at], salt)


def runs(flags: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set flags, cut where a text begins: (start, end) arrays."""
    if len(flags) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    inner = begin[(begin > 0) & (begin < len(flags))]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of ``width`` that starts at one of ``at``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, n), -1)
    return np.cumsum(change[:-1]) > 0
