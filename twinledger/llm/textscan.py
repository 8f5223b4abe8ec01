"""Numpy scanning of whole Arrow text columns: words, 64-bit word and window hashes. Helpers for tasks; no Spark here.

A text column arrives as one byte buffer with offsets. It is scanned in slices of whole documents, about SLICE bytes each,
so memory follows the slice (or the longest single document), not the batch.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64
# The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def give_back() -> None:
    """Returns freed memory to the system: Python workers stay alive, and the executor's other processes need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    got = _powers.get(base, np.ones(1, U64))
    while len(got) < n:
        got = np.concatenate([got, got * U64(pow(base, len(got), 2**64))])
    if len(got) <= 1 << 20:
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, offs


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of whole documents."""
    data, offs = text_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (with the word count at the end).
    gap says which bytes part words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~gap[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(data)
    run = np.empty(n + 1, U64)
    run[0] = 0
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=run[1:])
    h = (run[ends] - run[starts]) * powers(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(U64) * _M2 + U64(seed))


def window_sums(hashes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """For each i the polynomial hash of hashes[i:i+width] (as many as fit), whatever documents they come from."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    run = np.empty(n + 1, U64)
    run[0] = 0
    np.cumsum(hashes * powers(base, n), out=run[1:])
    return mix((run[width:] - run[:-width]) * powers(pow(base, -1, 2**64), n - width + 1))


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """For each i the 64-bit hash of the bytes data[i:i+width]."""
    return window_sums(_BYTE[data], width)
