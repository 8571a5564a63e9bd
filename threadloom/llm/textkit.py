"""Vectorised text kernels over Arrow string buffers: words, hashes, slices.

A slice is a run of whole documents of about ``SLICE_BYTES``; a longer document forms one
slice by itself, so whole texts are always seen.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64
_BASE = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LANE = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, not copied unless it has nulls; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets, data = column.buffers()[1], column.buffers()[2]
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int = SLICE_BYTES, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, and of at most ``most`` documents."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + most)
        yield lo, hi
        lo = hi


class Slice:
    """Bytes of some documents, their bounds, and lazily their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = True):
        raw = data[offsets[lo] : offsets[hi]]
        self.bytes = LOWER[raw] if lower else raw
        self.bounds = offsets[lo : hi + 1] - offsets[lo]
        self.docs = hi - lo

    def words(self) -> None:
        """Sets starts, ends, doc (of each word) and counts (of each document)."""
        n = len(self.bytes)
        word = ~IS_SPACE[self.bytes]
        edge = np.empty(n + 1, bool)
        edge[0] = n > 0 and word[0]
        edge[n] = n > 0 and word[n - 1]
        np.not_equal(word[1:], word[:-1], out=edge[1:n]) if n else None
        inner = self.bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        both = inner[word[inner] & word[inner - 1]] if n else inner  # words that touch across documents
        at = np.flatnonzero(edge)
        if len(both):
            both = np.unique(both)
            at = np.sort(np.concatenate([at, both, both]), kind="stable")
        self.starts, self.ends = at[0::2], at[1::2]
        first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(first)
        self.first = first
        self.doc = np.repeat(np.arange(self.docs), self.counts)

    def prefix_hash(self) -> np.ndarray:
        """Prefix sums for span hashes; exact modulo 2**64."""
        n = len(self.bytes)
        p, _ = powers(n + 1)
        s = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[self.bytes] * p[:n], out=s[1:])
        return s

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each span's bytes, the same wherever the span lies."""
        s = self.prefix_hash() if prefix is None else prefix
        _, inverse = powers(len(self.bytes) + 1)
        return mix((s[ends] - s[starts]) * inverse[starts])


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, one for every start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = words[:m] * LANE[0]
    for j in range(1, n):
        out += words[j : j + m] * LANE[j]
    return mix(out)


def tidy() -> None:
    """Gives freed memory back at the end of a task: workers are reused, and the executor's memory is shared with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def seg_starts(doc: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    if not len(doc):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)
