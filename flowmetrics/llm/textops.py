"""Vectorised text work on Arrow columns: words, 64-bit fingerprints, windows.

Words are runs of bytes outside a separator set (ASCII white space unless a
translation table says otherwise), so they equal the code-point definition
of the same set in UTF-8.  Fingerprints are 64-bit hashes of the word bytes;
two different words share one with probability 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93 | 1
_GRAM_INV = pow(_GRAM, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.cumprod(out)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
#: powers of _MULT and of its inverse, as far as they were needed
_POWERS = [np.zeros(0, U64), np.zeros(0, U64)]


def frugal(function: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that hands freed memory back at its end.

    Python workers wait for further tasks, and each would keep as much as its
    largest batch took, beside what the next stage needs.
    """

    @wraps(function)
    def run(*args, **named):
        try:
            yield from function(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about ``most`` bytes, one row at least."""
    sizes = pc.binary_length(column.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; null is empty."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_table(word_byte=None, fold_case: bool = False) -> np.ndarray:
    """256-byte translation table; 0 marks a separator.  ``word_byte``: predicate on byte values."""
    table = np.arange(256, dtype=np.uint8)
    if fold_case:
        table[65:91] += 32
    for b in range(256):
        if not (word_byte(b) if word_byte else b not in SPACES):
            table[b] = 0
    if word_byte is None:
        table[0] = 255  # a NUL byte is a word byte here; 0xFF never occurs in UTF-8
    return table


class Words:
    """Words of a run of rows.

    start, end: byte range of each word in ``data``; first[i]..first[i+1]:
    the words of row i; ``hashes()``: their 64-bit fingerprints.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.raw, self.offsets = raw, offsets
        data = self.data = table[raw]
        inside = data != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[edge < len(data)]
        begin[edge] |= inside[edge]
        edge = edge[edge > 0] - 1
        stop[edge] |= inside[edge]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    @classmethod
    def of(cls, column: pa.Array, table: np.ndarray) -> Words:
        return cls(*text_bytes(column), table)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        byte = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
        total = np.zeros(n + 1, U64)
        np.cumsum(byte[self.data] * powers(_MULT, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(_MULT_INV, n)[self.start])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprints that ``Words`` gives to ranges of bytes without separators."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    if n > len(_POWERS[0]):
        _POWERS[:] = [powers(base, max(n, 1 << 18)) for base in (_MULT, _MULT_INV)]
    np.cumsum(_BYTE[data] * _POWERS[0][:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _POWERS[1][starts])


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k-word windows inside rows, and the index of each one's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    valid = np.ones(n, bool)
    for lo, hi in zip(first[:-1], first[1:]):
        valid[max(lo, hi - k + 1) : hi] = False
    valid[n - k + 1 :] = False
    at = np.flatnonzero(valid)
    if k <= 8:
        out = np.empty(len(at), U64)
        for lo in range(0, len(at), 1 << 16):  # runs that stay in the CPU's cache
            here = at[lo : lo + (1 << 16)]
            part = hashes[here]
            for j in range(1, k):
                part *= U64(_GRAM)
                part += hashes[here + j]
            out[lo : lo + (1 << 16)] = mix(part)
        return out, at
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(_GRAM, n), out=total[1:])
    out = (total[at + k] - total[at]) * powers(_GRAM_INV, n)[at]
    return mix(out), at


def row_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row of each word index."""
    return np.searchsorted(first, at, side="right") - 1


def lists(values: np.ndarray, counts_to: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column: row i has values[counts_to[i]:counts_to[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(counts_to.astype(np.int32)), pa.array(values, kind))


def sequences(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each row's whole sequence of words."""
    counts = np.diff(first)
    place = mix(np.arange(1, int(counts.max(initial=0)) + 1, dtype=U64))
    at = place[np.arange(len(hashes)) - np.repeat(first[:-1], counts)]
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes ^ at) * (at | U64(1)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + counts.astype(U64))
