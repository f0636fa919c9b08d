"""Texts of an Arrow batch as one byte array, and 64-bit hashes of stretches of it, without loops over rows.

Hashes stand for byte strings. A stretch is taken eight bytes at a time; each group is mixed with its
place before the sum, so no pattern of bytes cancels out, and two different strings share a hash with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

GROUP = 8  # bytes that are mixed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a one-to-one map."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row borders; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, borders, data = column.buffers()
    n = len(column)
    if n == 0 or borders is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(borders, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(borders: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row that is longer."""
    a, n = 0, len(borders) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def places(n: int) -> np.ndarray:
    """A fixed random number for each place."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP)


def groups(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``raw[start:end]`` eight bytes at a time, the last filled up with zeros, and the number of each."""
    sizes = ends - starts
    n = -(-sizes // GROUP)
    first = np.cumsum(n) - n
    at = (np.arange(int(n.sum())) - np.repeat(first, n)) * GROUP + np.repeat(starts, n)
    padded = np.concatenate([raw, np.zeros(GROUP, np.uint8)])
    taken = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[at]
    last = first[n > 0] + n[n > 0] - 1
    over = (n * GROUP - sizes)[n > 0].astype(np.uint64) * np.uint64(8)
    taken[last] = taken[last] << over >> over
    return taken, n


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch ``raw[start:end]``; no stretch is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return hashes_of(*groups(raw, starts, ends), ends - starts)


def hashes_of(taken: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same from the groups of each stretch and its size in bytes."""
    first = np.cumsum(n) - n
    most = int(n.max(initial=1))
    inside = np.arange(len(taken)) - np.repeat(first, n) if most > 1 else np.zeros(len(taken), np.int64)
    terms = mixed(taken ^ places(most)[inside])
    return mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _MIX[0])


def runs(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest stretches of true bytes that do not cross a row border: starts and ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[borders] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends
