"""Array helpers used inside tasks: texts of an Arrow batch as one byte array, word spans, and span hashes.

A batch is taken in slices of a MB (a longer text is a slice of its own), so a task's memory depends on
the longest text and never on the number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95  # odd, so that powers have inverses modulo 2**64


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs where ``inside`` holds; a run never crosses a row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes other than ASCII white space."""
    return spans_of(~_SPACE[data], offsets)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a row's bytes are flagged."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def members(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give what a task has used back to the system: worker processes outlive their tasks, and other operators run in them."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from one running sum over the bytes."""
    size = 1 << max(16, int(len(data)).bit_length())
    ahead, back = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * ahead[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def hash_windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of ``size`` words within a row."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:count].copy()
    for k in range(1, size):
        total = mix(total * _MULTIPLIER + hashes[k : k + count])
    whole = np.flatnonzero(rows[:count] == rows[size - 1 :])
    return total[whole], whole


def repeated(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in its row more than once, not the first of its row) for each hash."""
    keyed = mix(hashes + rows.astype(np.uint64) * _MULTIPLIER)
    order = np.argsort(keyed, kind="stable")
    held = keyed[order]
    same = np.zeros(len(held) + 1, bool)
    same[1:-1] = held[1:] == held[:-1]
    twice, later = np.zeros(len(held), bool), np.zeros(len(held), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
