"""Words of whole Arrow string columns as numpy arrays: positions, documents and 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes outside space and 0x09-0x0D. Its hash is a polynomial over its bytes taken from prefix
sums (modulo 2**64, odd base, so each power can be undone), then mixed. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer document is a piece of its own.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


try:
    _trim = ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def release() -> None:
    """Give memory that a batch no longer needs back to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = np.ones(1, np.uint64)
_undo = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _undo
    if len(_powers) < n:
        n = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                x = np.cumprod(x, dtype=np.uint64)
                if k:
                    _undo = x
                else:
                    _powers = x
    return _powers, _undo


class Piece:
    """The words of some consecutive rows. Rows ``first`` to ``first + n_docs``; ``data`` holds their bytes, ``bounds`` their offsets."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, lower: bool):
        self.raw, self.bounds, self.first, self.n_docs = data, bounds, first, len(bounds) - 1
        self.data = _LOWER[data] if lower else data
        word = ~SPACE[data]
        edge = np.empty(len(data) + 1, bool)  # a word starts or has ended here
        edge[1:-1] = word[1:] != word[:-1]
        edge[0] = edge[-1] = False
        if len(data):
            edge[0], edge[-1] = word[0], word[-1]
        starts = edge[:-1] & word
        ends = edge.copy()
        ends[:-1] &= ~word
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        if len(inner):  # no word runs on into the next document
            cut = inner[word[inner] & word[inner - 1]]
            starts[cut] = ends[cut] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        self.first_word = np.searchsorted(self.starts, bounds)  # of each document, and the end
        self._sums = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, undo = _power(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(_BYTE[self.data] * power[: len(self.data)], dtype=np.uint64, out=self._sums[1:])
            return mix((self._sums[ends] - self._sums[starts]) * undo[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def grams(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one document, and where each starts."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        return gram_hash(hashes, n)[at], at


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values."""
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + hashes[k : k + m]
        return mix(out)


def pieces(column: pa.Array, lower: bool = False, limit: int = PIECE) -> Iterator[Piece]:
    """The rows of a string column, in pieces of about ``limit`` bytes. Nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:  # a null may stand over bytes that nobody wrote
        size = np.diff(offsets)
        if size[np.asarray(column.is_null())].any():
            yield from pieces(column.fill_null("") if not pa.types.is_binary(column.type) else column.fill_null(b""), lower, limit)
            return
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield Piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, lower)
        a = b
