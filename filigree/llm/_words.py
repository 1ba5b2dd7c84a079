"""Vectorised words and rolling hashes over Arrow string columns.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
All hashes are 64-bit polynomials with random odd bases, finished by a bijective mixer, and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text handled at once: temporaries stay within the cache, and memory doesn't depend on the batch.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers with good avalanche."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_folded = _table.copy()
_folded[65:91] = _table[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def rolling(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start and end."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


@dataclass
class Words:
    """Words of consecutive documents. offsets[i]:offsets[i+1] are the words of document i."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A hash of each word; fold: A-Z count as a-z."""
        return rolling((_folded if fold else _table)[self.data], BYTE_BASE, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all k-word windows that lie in one document, and offsets of each document's windows."""
        counts = np.maximum(np.diff(self.offsets) - (k - 1), 0)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        first = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1] - offsets[:-1], counts)
        return first, offsets

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows by document; a document with fewer words, but some, has its whole sequence."""
        first, offsets = self.windows(hashes, k)
        n = np.diff(self.offsets)
        short = np.flatnonzero((n > 0) & (n < k))
        out = rolling(hashes, WORD_BASE, first, first + k)
        if len(short):
            whole = rolling(hashes, WORD_BASE, self.offsets[short], self.offsets[short + 1])
            out = np.insert(out, offsets[short], whole)
            add = np.zeros(len(n) + 1, np.int64)
            add[short + 1] = 1
            offsets = offsets + np.cumsum(add)
        return out, offsets


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    _, bounds, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def slices(bounds: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(len(bounds), np.int64))
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1] | edge[1:-1]
    end[:-1] &= ~full[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def each(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, some rows at a time."""
    data, bounds = buffers(column)
    for a, b in slices(bounds, most):
        yield a, b, words(data, bounds[a : b + 1])


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in data[start:end] for each start and end."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[ends] - sums[starts]
