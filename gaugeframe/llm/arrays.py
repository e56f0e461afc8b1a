"""Vectorised helpers for tasks that work on whole texts: hashes of words and ranges, minimizers, packed columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd base, 5 modulo 8, so differences of neighbouring powers keep their bits.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A 64-bit symbol for every byte, and the same with A-Z as a-z.
SYMBOLS = mixed(np.arange(1, 257, dtype=U64) * U64(BASE))
LOWER_SYMBOLS = SYMBOLS.copy()
LOWER_SYMBOLS[65:91] = SYMBOLS[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for later calls."""
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, b in enumerate((BASE, BASE_INVERSE)):
            _POWERS[i] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64), dtype=U64)])
    return _POWERS[0][:n], _POWERS[1][:n]


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * up[:n], out=self.sums[1:], dtype=U64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1 - k + 1
        return mixed((self.sums[k:] - self.sums[: n]) * self.down[:n] + U64(k)) if n > 0 else np.zeros(0, U64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~IS_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, symbols: np.ndarray = SYMBOLS) -> np.ndarray:
    start, end = word_bounds(data)
    return Ranges(symbols[data]).of(start, end)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles in hash order; with fewer words the whole sequence is one, without words there is none."""
    if not len(words):
        return words
    return np.unique(Ranges(words).every(min(k, len(words))))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    span, r = 1, x
    while 2 * span <= w:
        r = f(r[:-span], r[span:])
        span *= 2
    n = len(x) - w + 1
    return f(r[:n], r[w - span : w - span + n])


def minimizers(values: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some w in a row; where equal values tie, all of them."""
    if len(values) < w:
        return np.zeros(0, np.int64)
    least = _sliding(values, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)])
    return np.flatnonzero(_sliding(padded, w, np.maximum) == values)


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column whose cells are consecutive pieces of `data`."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def narrow(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit numbers."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(U64, copy=False)


def give_back() -> None:
    """Hand freed memory back to the system. Python workers outlive their tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def batchwise(f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`f` for mapInArrow; a task that is done keeps no freed memory."""

    def g(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return g


def groupwise(f: Callable[[pa.Table], pa.Table]):
    """`f` for applyInArrow; a group that is done keeps no freed memory."""

    def g(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return g
