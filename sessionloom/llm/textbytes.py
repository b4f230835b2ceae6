"""Numpy helpers over blocks of UTF-8 text, for functions that run in Arrow tasks.

A block is the bytes of some neighbouring rows: ``data`` (uint8) and ``offsets`` (int64, one
more than rows).  Blocks are cut by bytes, so memory does not depend on the rows of a batch;
a text longer than the limit is a block of its own.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10   # hashing takes many bytes for one of text
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def worker_state(name: str, make: Callable[[], object]):
    """One object per Python worker process, made at first use and kept for its later tasks."""
    kept = sys.modules.setdefault("_sessionloom_worker", types.ModuleType("_sessionloom_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def release() -> None:
    """Give unused memory back to the system: Python workers stay for later tasks, and there are several per executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for blocks of the usual size."""
    have = _powers.get(base)
    if have is None or have.size < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if n <= BLOCK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, content = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, last, every[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes that are not white space; none crosses rows."""
    solid = ~SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    if data.size:
        begin[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        begin[offsets[filled]] = solid[offsets[filled]]
        finish[offsets[filled + 1] - 1] = solid[offsets[filled + 1] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums c with c[j] - c[i] = hash of data[i:j] times BASE^i."""
    sums = np.zeros(data.size + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * powers(BASE, data.size), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they lie."""
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, sums.size)[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xA24BAED4963EE407))
