"""Word and shingle hashing over Arrow batches, vectorised with numpy.

Words are the maximal runs of characters other than space and \\x09-\\x0D, after
A-Z are lower-cased; nothing else is folded. A word gets a 64-bit polynomial
hash of its bytes, a shingle a mix of its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), BASE | np.uint64(1), np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about `limit` bytes; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and the row boundaries in that list."""
    data = LOWER[data]
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[(offsets < len(data))]
    start[inner] = ~space[inner]
    starts = np.flatnonzero(start)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    longest = int(np.diff(np.append(starts, len(data))).max())
    # bytes before the first word count towards no word
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = BYTE[data[starts[0] :]]
    values *= powers(longest)[place]
    values[space[starts[0] :]] = 0
    return mix(np.add.reduceat(values, starts - starts[0])), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the hashes of its shingles in order; shorter rows give one shingle of all their words."""
    total = len(words)
    full = np.zeros(0, np.uint64)
    if total >= size:
        full = np.zeros(total - size + 1, np.uint64)
        for j in range(size):
            full = mix(full + words[j : total - size + 1 + j])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield full[a : b - size + 1]
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one + words[j : j + 1])
            yield one
        else:
            yield full[:0]
