"""Hashed words and windows of words as NumPy arrays, straight from the bytes of Arrow columns.

The words of many texts are hashed at once: a running sum of bytes times powers of an odd base gives the polynomial of
any stretch of bytes as a difference, and the inverse power moves it to the origin. No word becomes a Python object.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # the base of windows
#: Bytes that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def released() -> None:
    """Hands what a task has freed back to the machine; workers live on, and executors are small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """run, a function of batches, that hands back what it has freed when its task ends: of a stage's two workers each keeps
    what the largest of its tasks took, else, through all stages that follow."""

    def lean(batches):
        yield from run(batches)
        released()

    return lean


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; a word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
    carriage return. lower maps A-Z alone."""

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.powers, self.inverses = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n = len(data)
        if not n:
            yield from [np.zeros(0, np.uint64)] * (len(offsets) - 1)
            return
        self._reach(n)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets[:-1]] = edge[-1] = True  # texts do not run into each other
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if self.lower:
            data = _LOWER[data]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)))
            hashes = _mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield hashes[a:b]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of the words of each text of a binary column; none for null."""
        if column.null_count:
            column = column.fill_null(b"")
        if not len(column):
            return
        wide = pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            yield from self._chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of so many words: polynomials, put together from windows of 1, 2, 4 ... words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, part, width, power = np.zeros(n, np.uint64), 0, words, 1, _STEP
    with np.errstate(over="ignore"):
        while done < length:
            if length & width:
                total = total * power + part[done : done + n]
                done += width
            part = part[:-width] * power + part[width:] if len(part) > width else part
            power, width = power * power, 2 * width
        return _mixed(total)


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of the windows; one of the whole sequence where there are fewer words."""
    return np.unique(window_hashes(words, min(length, len(words)))) if len(words) else np.zeros(0, np.uint64)
