"""Vectorised text work on Arrow string columns: bytes, words and hashes in numpy.

A column's UTF-8 bytes and offsets are used as they lie in the Arrow buffers, in
slices of a few MB so that a task's memory does not follow the batch size. Nulls
are empty texts. A row larger than a slice is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def trim() -> None:
    """Gives freed memory back to the system at a task's end: a worker lives on, and the next task's peak adds to what it keeps."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive row runs of at most max_bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, data = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, U64(base & 0xFFFFFFFFFFFFFFFF), dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of the polynomial in base; see span_hash."""
    out = np.zeros(len(values) + 1, dtype=U64)
    if len(values):
        np.cumsum((values.astype(U64) + U64(1)) * powers(len(values), base), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of values[start:end), the same wherever the values stand."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    back = powers(len(prefix), inverse(base))[start]
    length = (end - start).astype(U64)
    return mix((prefix[end] - prefix[start]) * back + length * U64(0xD6E8FEB86659FD93))


def lower_ascii_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii_table()


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, which never cross a row, and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    finish[last] = inside[last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)
