"""Vectorised word hashing over Arrow string columns.

A column's UTF-8 buffer is read as one byte array; words are runs of bytes that are not
ASCII white space, and never cross a row. Each word gets a 64-bit hash from polynomial
prefix sums modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
CHUNK_BYTES = 1_000_000
SLICE_ROWS = 2500

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    """Of the words of rows lo .. hi-1: hashes, and the bounds of each row's words."""

    lo: int
    hi: int
    hashes: np.ndarray
    bounds: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; nulls are empty rows."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def decoded(column: pa.Array) -> list[str | None]:
    """The texts of a binary column; bytes that are no UTF-8 are replaced by U+FFFD."""
    return [None if t is None else t.decode("utf-8", "replace") for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of long texts stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def pieces(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Hashes of all words of a column, in pieces of rows."""
    data, offsets = utf8(column)
    for lo, hi in pieces(offsets):
        o = offsets[lo : hi + 1] - offsets[lo]
        b = data[offsets[lo] : offsets[hi]]
        if lower:
            b = LOWER[b]
        n = len(b)
        if not n:
            yield Words(lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
            continue
        blank = BLANK[b]
        first = np.ones(n, bool)
        first[1:] = blank[:-1]
        first[o[:-1][o[:-1] < n]] = True
        starts = np.flatnonzero(first & ~blank)
        last = np.ones(n, bool)
        last[:-1] = blank[1:]
        last[o[1:][o[1:] > 0] - 1] = True
        ends = np.flatnonzero(last & ~blank)
        sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)
        h = sums[ends]
        h -= np.where(starts > 0, sums[starts - 1], np.uint64(0))
        h *= powers(INVERSE, n)[starts]
        yield Words(lo, hi, mix(h), np.searchsorted(starts, o))


GRAM = powers(0xD6E8FEB86659FD93, 64)


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside rows, and the bounds of each row's windows."""
    sizes = np.maximum(0, np.diff(bounds) - (k - 1))
    out = np.concatenate(([0], np.cumsum(sizes)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], sizes)
    total = h[at] * GRAM[0]
    for j in range(1, k):
        total = total + h[at + j] * GRAM[j]
    return mix(total), out


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes.

    A row of fewer words has its whole sequence as its one shingle; a row without words
    has none.
    """
    for w in words(column):
        g, bounds = grams(w.hashes, w.bounds, k)
        for i in range(w.hi - w.lo):
            own = g[bounds[i] : bounds[i + 1]]
            if not len(own) and (m := w.bounds[i + 1] - w.bounds[i]):
                seq = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                yield mix(np.array([(seq * GRAM[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64))
            else:
                yield np.unique(own)
