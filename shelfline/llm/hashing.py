"""64-bit hashes of many byte spans at once, for tasks that hash every word of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C13
_OF_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    known = _tables.get(base)
    if known is None or len(known) < n:
        known = np.empty(max(n, 1 << 16), dtype=np.uint64)
        known[0], done = 1, 1
        while done < len(known):
            step = min(done, len(known) - done)
            known[done : done + step] = known[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if len(known) <= 1 << 21:
            _tables[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of data[starts[i]:ends[i]] with its length mixed in; one for each odd base.

    One running sum over the bytes gives every span's polynomial times a power of its start, which an inverse
    power takes away again.
    """
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[data] * powers(base, len(data)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(data) + 1)[starts]
    return out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a binary column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]
