"""NumPy kernels over the bytes of many texts at once: slices of Arrow columns, word spans and 64-bit span hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at a time, so that the work arrays stay in the cache. A longer text is one slice.
SLICE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(SLICE + 1, n + 1)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[: n + 1]


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `most` bytes."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class SpanHash:
    """Hashes of any spans of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U)
        terms = _BYTE[data]
        terms *= _power(_BASE, n)[:n]
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = _power(_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.inverse[start]
        return mix(h)

    def windows(self, size: int) -> np.ndarray:
        """Of each window of `size` bytes, by its start."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.inverse[: len(h)]
        return mix(h)


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all) of the maximal runs of true bytes; no run crosses a text's end."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def blank_words(data: np.ndarray, offsets: np.ndarray):
    """Spans of the words [^\\x20\\x09-\\x0D]+."""
    return word_spans(~_BLANK[data], offsets)


def alnum_words(data: np.ndarray, offsets: np.ndarray):
    """Spans of runs of ASCII letters, digits and non-ASCII bytes."""
    return word_spans(_ALNUM[data], offsets)
