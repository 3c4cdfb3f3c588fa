"""Numpy kernels over Arrow text columns: words, 64-bit word hashes, byte groups of bounded size.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); as UTF-8 continuation
bytes never fall in that set, byte runs and ``[^\\x20\\x09-\\x0D]+`` agree.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles, unless a single text is longer.
GROUP_BYTES = 1 << 21

_NAME = ctypes.util.find_library("c")
_LIBC = ctypes.CDLL(_NAME) if _NAME and hasattr(ctypes.CDLL(_NAME), "malloc_trim") else None

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = spread(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, which: str) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, _BASE if which == "up" else _UNBASE, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * GROUP_BYTES:
            _POWERS[which] = have
    return have[:n]


def release() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of rows of text or binary; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, every[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
    del column, every, offsets
    release()


def segments(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``groups``, but a text much longer than limit comes in several parts, cut at white space."""
    for low, high, buf, offsets in groups(column, limit):
        if len(buf) <= 2 * limit:
            yield low, high, buf, offsets
            continue
        at = 0
        while at < len(buf):
            space = np.flatnonzero(SPACE[buf[at + limit : at + 2 * limit]])
            # A word longer than limit is not cut: the part goes on to where it ends.
            end = at + limit + int(space[0]) if len(space) else _next_space(buf, at + 2 * limit)
            yield low, high, buf[at:end], np.array([0, end - at])
            at = end


def _next_space(buf: np.ndarray, at: int) -> int:
    while at < len(buf):
        space = np.flatnonzero(SPACE[buf[at : at + GROUP_BYTES]])
        if len(space):
            return at + int(space[0])
        at += GROUP_BYTES
    return len(buf)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; rows never share one."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(buf)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = cuts[cuts > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal spans anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _powers(len(buf), "up"), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(len(buf) + 1, "down")[starts] + (ends - starts).astype(np.uint64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """For ascending row numbers, where each of n rows begins and ends among them (n + 1 bounds)."""
    return np.searchsorted(rows, np.arange(n + 1))
