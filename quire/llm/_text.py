"""Vectorised work on batches of UTF-8 texts.

A batch is one byte array with document offsets. Words are found, hashed and
combined into word-sequence hashes with whole-array operations, a megabyte or
one document at a time, so memory doesn't depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.RandomState(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_power = {b: (np.ones(1, np.uint64), np.ones(1, np.uint64)) for b in _BASES}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = _BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_power[base][0]) < n:
        out = []
        for x in (base, pow(base, -1, 2**64)):
            p = np.full(max(n, CHUNK + 1), x, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _power[base] = out[0], out[1]
    return _power[base][0][:n], _power[base][1][:n]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes.

    ``column`` holds binary or string values; null rows are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each document's first word (one more at the end)."""
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[[0, n]] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        p, q = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * p, out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (total[e] - total[s]) * q[s]
        a = b
    return mix(out)


def sequence_hashes(h: np.ndarray, k: int, nth: int = 0) -> np.ndarray:
    """Hash of the k words that start at each word; k - 1 fewer than words. ``nth`` chooses one of two hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        p, q = powers(b - a + k, _BASES[nth])
        total = np.zeros(b - a + k, np.uint64)
        np.cumsum(h[a : b + k - 1] * p[: b - a + k - 1], out=total[1:])
        out[a:b] = (total[k:] - total[: b - a]) * q[: b - a]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each lower-cased text.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    for a, b, data, offsets in chunks(column):
        data = lowered(data)
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        s = sequence_hashes(h, k)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= k:
                x = np.sort(s[lo : hi - k + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif hi > lo:
                yield sequence_hashes(h[lo:hi], hi - lo) + np.uint64(hi - lo)
            else:
                yield h[:0]
