"""Vectorised tokenising and hashing of Arrow text columns; small helpers that run inside Spark tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are functions of the bytes alone, so they agree between
tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Masks of the first 0 to 8 bytes.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a word beyond which it is hashed on its own.
LONG_WORD = 256


#: Tables of powers are kept up to this length, which slices of a megabyte need; a longer text has its own while it is read.
KEPT_POWERS = (1 << 20) + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    a, b = _kept_powers() if n <= KEPT_POWERS else _powers(n)
    return a[:n], b[:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``width`` values: prefix sums of value * BASE**i, differenced and shifted back."""
    n = len(values)
    if n < width:
        return np.empty(0, U64)
    up, down = powers(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


@dataclass
class Words:
    """The words of some documents. first[d] to first[d + 1] are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: its length, then eight bytes at a time, go through the finaliser. Very long words get XXH64."""
        size = self.end - self.start
        h = mix((size.astype(U64) + U64(1)) * U64(BASE))
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
        at, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(at):
            left = size[at] - k
            part = eight[self.start[at] + k] & FIRST_BYTES[np.minimum(left, 8)]
            h[at] = mix((h[at] ^ part) * U64(BASE) + U64(k + 1))
            at, k = at[left > 8], k + 8
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), 42)
        return h

    def windows(self, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``width`` words that lie in one document, and the index of each one's first word."""
        if len(values) < width:
            return np.empty(0, U64), np.empty(0, np.int64)
        last = np.repeat(self.first[1:], self.counts) - width
        at = np.flatnonzero(np.arange(len(values)) <= last)
        return rolling(values, width)[at], at


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Tokenise documents that lie one after the other in ``data``; document d is data[offsets[d]:offsets[d + 1]]."""
    separator = SEPARATOR[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = separator[:-1]
        after[:-1] = separator[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = True
        after[offsets[1:][filled] - 1] = True
    start = np.flatnonzero(~separator & before)
    end = np.flatnonzero(~separator & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets).astype(np.int64))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi whose texts have about ``most`` bytes together, their bytes and offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) that depends on the id and the seed alone."""
    h = mix(mix(ids.astype(np.int64).view(U64) + U64(seed)) ^ U64(BASE))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / 2.0**53


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
