"""Vectorised words, window hashes and sets over Arrow text columns (numpy, no loop per word)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
SALTS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n - 1, 0), base, U), dtype=U)])[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``SLICE_BYTES``."""
    data, at = raw(col)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and rows of all words; a word never crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        values = BYTE[data[np.repeat(starts, lengths) + within]] * powers(int(lengths.max()))[within]
        return mix(np.add.reduceat(values, first) + lengths.astype(U) * SALTS[0])


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that stays in one row, and where it starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    base = SALTS[lane]
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, width):
            out = out * base + hashes[j : n + j]
    start = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(out[start]), start


def counts_before(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the first word of each row, and the number of words at the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1), "left")


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each row, sorted; a row with fewer words has
    one shingle of all its words."""
    starts, ends, rows = bounds(data, at)
    h = word_hashes(LOWER[data], starts, ends)
    w, pos = windows(h, rows, width)
    out_rows, out = [rows[pos]], [w]
    first = counts_before(rows, len(at) - 1)
    n = np.diff(first)
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            with np.errstate(over="ignore"):
                v = h[first[short]].copy()
                for j in range(1, k):
                    v = v * SALTS[0] + h[first[short] + j]
            out_rows.append(short)
            out.append(mix(v ^ U(k)))
    r, v = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[new], v[new]
