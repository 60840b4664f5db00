"""Texts of an Arrow batch as byte arrays: words, their hashes and hashes of byte windows.

All of it is numpy over some megabytes of text at a time; hashes have 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20

_powers = np.ones(1, U64), np.ones(1, U64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            inverse = U64(pow(int(BASE), -1, 1 << 64))
            _powers = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64))]) for b in (BASE, inverse))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and n + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer text is a run by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Ranges of more bytes are hashed and compared one by one.
LONG = 256
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as one number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of byte ranges, mixed 8 bytes at a time; of up to 8 bytes, different ranges of one size never collide."""
    size, lanes = end - start, _lanes(data)
    out = mix(lanes[start] & _LOW[np.minimum(size, 8)]) + mix(size.astype(U64) + BASE)
    more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        lane = lanes[start[more] + k] & _LOW[np.minimum(size[more] - k, 8)]
        out[more] = mix(out[more] * BASE + lane)
        k += 8
        more = more[size[more] > k]
    long = np.flatnonzero(size > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return mix(out)


def equal(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``a`` from i on are those of ``b`` from j on."""
    one, other = _lanes(a), _lanes(b)
    same = np.ones(len(size), bool)
    more, k = np.flatnonzero(size <= LONG), 0
    while len(more):
        apart = (one[i[more] + k] ^ other[j[more] + k]) & _LOW[np.minimum(size[more] - k, 8)]
        same[more] &= apart == 0
        k += 8
        more = more[size[more] > k]
    for x in np.flatnonzero(size > LONG).tolist():
        same[x] = np.array_equal(a[i[x] : i[x] + size[x]], b[j[x] : j[x] + size[x]])
    return same


class Rolling:
    """Hashes of byte windows, by sums of byte values times powers. Modulo 2**64 patterned strings can
    collide: these hashes choose and pre-sort, and what they bring together is compared by its bytes."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * self.powers[: len(data)], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Of the k bytes from each place."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII white space), and the n + 1 places at
    which each text's words begin among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    start[first] = solid[first]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = solid[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


STEP = mix(np.arange(1, 9, dtype=U64)) | U64(1)


def shingles(word_hashes: np.ndarray, places: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and their n + 1 places. A text of
    fewer words has its whole sequence as one run; without words it has none."""
    counts = np.diff(places)
    got = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(got)])
    doc = np.repeat(np.arange(len(counts)), got)
    start = places[:-1][doc] + np.arange(len(doc)) - at[:-1][doc]
    width = np.minimum(counts, size)[doc]
    total = mix(width.astype(U64) + BASE)
    for j in range(size):
        inside = width > j
        if len(word_hashes):
            total = np.where(inside, mix(total * BASE + word_hashes[np.minimum(start + j, len(word_hashes) - 1)]), total)
    return total, at
