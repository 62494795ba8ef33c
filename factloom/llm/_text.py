"""Vectorised word hashing over Arrow string batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_WIN = 1 << 18
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def relax() -> None:
    """Give freed memory back to the system: an executor's Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _powers(x: U) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(_WIN, x, U)]), dtype=U)


_POW, _IPOW = _powers(_BASE), _powers(_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string array; nulls are empty."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.string() if pa.types.is_large_string(arr.type) else pa.binary())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(arr: pa.Array, size: int = 1 << 20):
    """Slices of whole rows, each about ``size`` bytes or one row, with their first row."""
    _, off = raw(arr)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, arr.slice(i, j - i)
        i = j


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word of the lower-cased texts, and the first word of each row (rows + 1).

    A word is a run of ASCII letters or digits or of bytes over 127.
    """
    data, off = raw(pc.utf8_lower(arr))
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U), e, e, np.zeros(len(off), np.int64)
    inside = _WORD[data]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    cuts = off[:-1]
    prev[cuts[cuts < n]] = False
    start = np.flatnonzero(inside & ~prev)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:] & prev[1:]
    end = np.flatnonzero(inside & ~after) + 1
    lo, hi, inv = np.empty(len(start), U), np.empty(len(start), U), np.empty(len(start), U)
    carry, base, ibase = U(0), U(1), U(1)
    with np.errstate(over="ignore"):
        for w in range(0, n, _WIN):
            part = data[w : w + _WIN].astype(U)
            part += U(1)
            part *= _POW[: len(part)]
            part *= base
            c = np.empty(len(part) + 1, U)
            c[0] = carry
            np.cumsum(part, out=c[1:])
            c[1:] += carry
            a, b = np.searchsorted(start, [w, w + _WIN])
            lo[a:b] = c[start[a:b] - w]
            inv[a:b] = _IPOW[start[a:b] - w] * ibase
            a, b = np.searchsorted(end, [w + 1, w + len(part) + 1])
            hi[a:b] = c[end[a:b] - w]
            carry, base, ibase = c[-1], base * _POW[_WIN], ibase * _IPOW[_WIN]
        h = mix((hi - lo) * inv)
    return h, start, end, np.searchsorted(start, off)
