"""Whole texts of an Arrow column as byte arrays, cut into hashed words with numpy.

Words are maximal runs of bytes that a 256-entry table maps to a non-zero byte.
All separators used here are ASCII, so runs of UTF-8 bytes are runs of code points.
A word's hash is a polynomial over random byte values modulo 2**64 with a final
mix; equal words have equal hashes on every executor, because all constants come
from fixed seeds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.Philox(20240131))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; a longer text has its own for as long as it is read.
MOST_POWERS = 1 << 21


def table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte table: separators map to 0, A-Z to a-z if lower, everything else to itself."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 255  # NUL may be part of a word; 255 never occurs in UTF-8
    if lower:
        out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words of letters, digits and everything outside ASCII.
ALNUM_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WORDS = table(SPACE, False)
WORDS_LOWER = table(SPACE, True)
ALNUM_LOWER = table(ALNUM_SEPARATORS, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix-style finalizer, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= _MUL
    x ^= x >> np.uint64(27)
    x *= _MUL2
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(step)
            done, step = done + more, step * step % 2**64
        if size <= MOST_POWERS:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most so many bytes together (or one document)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of documents [i, j) of a batch.

    start, end: byte positions in `raw`; at: for each document the range of its words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, byte_table: np.ndarray):
        self.raw, self.n_docs = raw, len(offsets) - 1
        mapped = byte_table[raw]
        inside = mapped != 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, offsets)
        self._mapped = mapped

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        if not len(self.start):
            return np.empty(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        values = _BYTE[self._mapped]
        values *= _power(_BASE, n)
        np.cumsum(values, out=total[1:])
        out = total[self.end] - total[self.start]
        out *= _power(_INVERSE, n)[self.start]
        out += (self.end - self.start).astype(np.uint64)
        return mix(out)

    def owner(self) -> np.ndarray:
        """For each word the number of its document within the slice."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.at))

    def left(self) -> np.ndarray:
        """For each word how many words its document still has, itself included."""
        return np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self.start))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for every i with n words from there on."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    k = len(words) - n + 1
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += words[j : j + k]
    return mix(out)


def documents(column: pa.Array, byte_table: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, Words]]:
    """Slices of a text column as (first document, end, words)."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets, most):
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], byte_table)


def give_back() -> None:
    """Return memory that is free but still held by this process to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(work: Work) -> Work:
    """work, after which its worker, kept for other tasks and stages, doesn't hold on to what it no longer needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
