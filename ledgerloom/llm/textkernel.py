"""Vectorised word kernels over Arrow string columns.

A batch of texts is one UTF-8 byte buffer with document offsets.  Words are the
maximal runs of bytes other than 0x20 and 0x09-0x0D, so no UTF-8 sequence is ever
split.  Every function is a pure function of the batch; nothing is kept between
calls, so a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = 0x5EED_0F_1005
_rng = np.random.default_rng(_SEED)
#: One random odd 64-bit value a byte; A-Z take the values of a-z when folding.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
SHINGLE_WEIGHT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

KEPT = (1 << 20) + 1
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; up to KEPT of them are kept for the next call."""
    global _power, _inverse
    if len(_power) >= n:
        return _power, _inverse
    size = n if n > KEPT else min(KEPT, 1 << (n - 1).bit_length())
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= KEPT:
        _power, _inverse = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # zero chunks
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of whole texts, about `size` bytes each."""
    data, offs = buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Word boundaries of a slice: `start` and `end` in bytes, `first[d]` the first word of document d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        word = np.empty(n + 1, bool)
        np.logical_not(_SPACE[data], out=word[:n])
        word[n] = False
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = word[:n]
        self.start = np.flatnonzero(word & (~before | edge))
        self.end = np.flatnonzero(before & (~word | edge))
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def hashes(self, values: np.ndarray = FOLDED_VALUE) -> np.ndarray:
        """A 64-bit hash of each word; bytes whose value is 0 do not count."""
        return self.prefix_hashes(values)[0]

    def prefix_hashes(self, values: np.ndarray, *sizes: int) -> list[np.ndarray]:
        """hashes(), then those of each word's first `size` bytes, for each size."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[self.data] * power[: len(self.data)], out=total[1:])
        before, scale = total[self.start], inverse[self.start]
        return [mix((total[end] - before) * scale) for end in (self.end, *(np.minimum(self.end, self.start + n) for n in sizes))]

    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows that stay inside a document, and the index of each one's first word."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = hashes[: len(hashes) - n + 1] * SHINGLE_WEIGHT[0]
        for k in range(1, n):
            out += hashes[k : len(hashes) - n + 1 + k] * SHINGLE_WEIGHT[k]
        whole = np.ones(len(out), bool)
        for b in self.first[1:-1]:
            whole[max(0, b - n + 1) : b] = False
        at = np.flatnonzero(whole)
        return mix(out[at]), at


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document; with fewer words the whole sequence is one."""
    h = words.hashes()
    g, at = words.grams(h, n)
    cut = np.searchsorted(at, words.first)
    out = []
    for d, count in enumerate(words.count):
        if count >= n:
            out.append(np.unique(g[cut[d] : cut[d + 1]]))
        elif count:
            own = h[words.first[d] : words.first[d + 1]]
            total = (own * SHINGLE_WEIGHT[:count]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(total + SHINGLE_WEIGHT[32 + count : 33 + count]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(values: np.ndarray) -> int:
    """64 bits that name a sorted set."""
    if not len(values):
        return 0
    a = int((values * SHINGLE_WEIGHT[40]).sum(dtype=np.uint64)) + int((mix(values ^ SHINGLE_WEIGHT[41])).sum(dtype=np.uint64)) * 3
    return int(mix(np.array([(a + len(values) * int(SHINGLE_WEIGHT[42])) & (2**64 - 1)], np.uint64))[0])
