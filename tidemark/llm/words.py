"""Whole-batch word splitting and hashing on Arrow string buffers (numpy, no per-row Python).

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  Null texts are empty.
Every function works on whole texts; slices only bound the memory in use, never what is read.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers, by sorting (np.unique hashes them, at many times the cost)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


#: Words of one stretch, whose hash is mixed before the next stretch joins.
STRETCH = 64


class _Family:
    """Hashes of words by mixing eight bytes at a time, and of short runs of words by a polynomial.

    The polynomial is taken modulo 2**64 with an odd base, which strings of a regular build defeat if they are
    long (a Thue-Morse string of 2,048 symbols and its complement collide for every base).  So it only
    serves runs of up to STRETCH words; words, and longer runs, are mixed step by step.
    """

    def __init__(self, seed: int) -> None:
        self.seed = mix64(np.array([seed], dtype=_U))[0]
        self.base = _U(int(self.seed) | 1)
        self.inverse = _U(pow(int(self.base), -1, 1 << 64))
        self.powers = self.unpowers = np.ones(1, dtype=_U)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each word: every eight bytes, and the length, are mixed into what came before."""
        size = ends - starts
        out = mix64(size.astype(_U) ^ self.seed)
        if not len(size):
            return out
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
        live, at = np.arange(len(size)), starts
        left = size
        while len(live):
            block = eight[at]
            block &= _MASKS[np.minimum(left, 8)]
            out[live] = mix64(out[live] ^ block)
            on = left > 8
            live, at, left = live[on], at[on] + 8, left[on] - 8
        return out

    def long_spans(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each span of any length: stretch by stretch, each mixed into what came before."""
        size = ends - starts
        out, pieces = mix64(size.astype(_U) ^ self.seed), -(-size // STRETCH)
        first = np.cumsum(pieces) - pieces
        begin = np.repeat(starts, pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * STRETCH
        part = self.spans(symbols, begin, np.minimum(begin + STRETCH, np.repeat(ends, pieces)))
        live, step = np.flatnonzero(pieces), 0
        while len(live):
            out[live] = mix64(out[live] ^ part[first[live] + step])
            step += 1
            live = live[pieces[live] > step]
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            m = max(n, 1 << 16)
            for name, base in (("powers", self.base), ("unpowers", self.inverse)):
                p = np.full(m, base, dtype=_U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=_U))
        return self.powers, self.unpowers

    def spans(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each span [start, end) of the symbols, STRETCH of them at most."""
        n = len(symbols)
        powers, unpowers = self.upto(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(symbols * powers[:n], dtype=_U, out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * unpowers[starts] ^ (ends - starts).astype(_U))


#: Keeps the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
FAMILIES = (_Family(11), _Family(23))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (len + 1, from 0) and bytes of a string column; nulls become empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def byte_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes each, and of one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a batch of texts: byte starts and ends, and the row each belongs to."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray) -> None:
        self.offsets, self.data, self.rows = offsets, data, len(offsets) - 1
        inside = ~SPACE[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        before[offsets[:-1]] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        after[offsets[1:]] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        if family not in self._hashes:
            self._hashes[family] = FAMILIES[family].words(self.data, self.starts, self.ends)
        return self._hashes[family]

    def windows(self, hashes: np.ndarray, length: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which `length` words of one row begin, and the hashes of those windows."""
        n = len(hashes)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
        at = np.flatnonzero(self.row[: n - length + 1] == self.row[length - 1 :])
        return at, FAMILIES[family].spans(hashes, at, at + length)


_CACHE: dict = {}
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator keeps its own counsel
    _LIBC = None


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """This worker's one cache: kept for the same key, and let go when work with another key begins."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """(first row, Words) of byte-bounded row ranges of a column."""
    offsets, data = buffers(texts)
    for a, b in byte_slices(offsets, limit):
        yield a, Words(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
    give_back()


def slices_of(texts: pa.Array, table: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """The same, with every byte replaced by its entry in a table of 256 bytes (white space there ends words)."""
    offsets, data = buffers(texts)
    for a, b in byte_slices(offsets, limit):
        yield a, Words(offsets[a : b + 1] - offsets[a], table[data[offsets[a] : offsets[b]]])
    give_back()


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on batches, handing memory back once its last arrays are gone."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Hand freed memory to the system, which a long-lived worker's allocators otherwise keep."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
