"""Vectorised word kernels over Arrow string columns.

A column's UTF-8 buffer is read as one byte array and cut into slices of whole
documents of about ``SLICE`` bytes, so that memory stays bounded whatever the
batch.  Words are found by a byte class, and hashed by a polynomial over 2**64
with one prefix sum; n-grams of words are hashed the same way over word hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
_U = np.uint64


def _byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    word = np.ones(256, dtype=bool)
    for lo, hi in separators:
        word[lo : hi + 1] = False
    return word


#: Separators are all of ASCII but digits and lower-case letters.
ALNUM = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Separators are space and tab to carriage return.
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_Q = _U(0xC2B2AE3D27D4EB4F)
_P_INV = _U(pow(int(_P), -1, 2**64))
_Q_INV = _U(pow(int(_Q), -1, 2**64))

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 64 * SLICE:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of a slice of documents."""

    data: np.ndarray  # bytes of the slice (folded, if asked for)
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # past the last byte of each word
    value: np.ndarray  # 64-bit hash of each word
    first: np.ndarray  # index of each document's first word; one more at the end
    doc: int  # row of the slice's first document in the batch

    def __len__(self) -> int:
        return len(self.first) - 1

    def spell(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole documents."""
    at, data = string_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, at[row : stop + 1] - at[row], data[at[row] : at[stop]]
        row = stop


def words(column: pa.Array, kind: np.ndarray, fold: bool, hashed: bool = True, size: int = SLICE) -> Iterator[Words]:
    """The words of each slice of about ``size`` bytes. ``fold`` lower-cases A-Z first."""
    for row, at, data in slices(column, size):
        if fold:
            data = _FOLD[data]
        n = len(data)
        inside = kind[data]
        begin, close = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            close[:-1] &= ~inside[1:]
            filled = at[:-1][at[:-1] < at[1:]]
            begin[filled] = inside[filled]
            last = at[1:][at[:-1] < at[1:]] - 1
            close[last] = inside[last]
        start, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        value = np.zeros(0, dtype=np.uint64)
        if hashed and len(start):
            value = spans(data, start, end)
        yield Words(data, start, end, value, np.searchsorted(start, at), row)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    n = len(data)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE_VALUE[data] * _power(_P, n), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _power(_P_INV, n + 1)[start] + (end - start).astype(np.uint64))


def ngrams(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values; one for each start that has n values after it."""
    m = len(value) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.empty(len(value) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(value * _power(_Q, len(value)), out=prefix[1:])
    return mix((prefix[n:] - prefix[:m]) * _power(_Q_INV, len(value) + 1)[:m] + _U(n))


#: What a worker process keeps from task to task, for as long as its tasks are of one kind.
process_cache: dict[str, object] = {}


def make_room(keep: bool = False) -> None:
    """Called as a task of another kind starts (or, with ``keep``, as one ends):
    a worker serves many tasks, and what it has freed must be the machine's again."""
    if not keep:
        process_cache.clear()
        _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
