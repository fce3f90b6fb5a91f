"""Vectorised text hashing: words of a block of texts as 64-bit hashes.

A word's hash is a sum over its bytes of random(byte) * base**position, taken
from one wrapped prefix sum over the whole block, so that no Python code runs
per word.  The sums are mixed at the end.  Work goes in pieces of about
``PIECE`` bytes cut at word bounds, so temporaries stay bounded whatever the
length of a text.
"""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None

PIECE = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE + 1, 1 << n.bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (_BASE, _INV):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[size] = tuple(out)
    return _powers[size]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] for ascending, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _M2)
        i = j
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside`` bytes, also cut where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 22):
    """(first, last) row ranges whose texts hold about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each text, and word offsets (n + 1)."""
    s, e = spans(~SPACE[data], offsets)
    return spans_hash(LOWER[data], s, e), np.searchsorted(s, offsets)


def batches(iterator, rows: int = 2000):
    """Arrow batches cut to ``rows`` rows at most, without copying."""
    for batch in iterator:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)
