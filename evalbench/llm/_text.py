"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with ASCII letters lower-cased. Hashes are
polynomial in the bytes modulo 2**64 and finished by a bit mixer, so a word's hash costs a difference of
prefix sums. Everything works on slices of a megabyte; one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 25:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 1 << 20, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and ``most`` bytes, a single row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1), start + rows)
        yield start, stop
        start = stop


def batches(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 62) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, most, rows):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    low = _LOWER[data] if lower else data
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((low.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts])


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each row, and each row's first one (one more at the end).

    A row of 1 to ``width`` - 1 words has a single shingle, of all its words; a row without words has none.
    """
    if not len(h):
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    sizes = np.diff(first)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - width + 1, 1))
    off = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=off[1:])
    padded = np.concatenate([h, np.zeros(width - 1, U64)])
    total = np.zeros(len(h), U64)
    for j in range(width):
        total += padded[j : j + len(h)] * powers(_BASE, width + 1)[j + 1]
    keep = np.zeros(len(h) + 1, np.int8)
    lo = first[:-1][counts > 0]
    keep[: len(h)] = 0
    run = np.zeros(len(h) + 1, np.int64)
    np.add.at(run, lo, 1)
    np.add.at(run, lo + counts[counts > 0], -1)
    at = np.flatnonzero(np.cumsum(run[:-1]) > 0)
    out = total[at]
    for d in np.flatnonzero((sizes > 0) & (sizes < width)):
        own = h[first[d] : first[d + 1]]
        out[off[d]] = (own * powers(_BASE, width + 1)[1 : len(own) + 1]).sum(dtype=U64)
    return mix(out), off


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' first elements."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sequence_hash(h: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """A hash of each row's words in order."""
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        place = np.arange(len(h)) - first[:-1][row_of(first)]
        out[some] = np.add.reduceat(h * powers(base, int(place.max()) + 2)[place + 1], first[:-1][some])
    return mix(out + np.diff(first).astype(np.uint64))
