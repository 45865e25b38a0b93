"""Words and their hashes from the bytes of an Arrow string column.

A word is a longest run of characters outside space and U+0009..U+000D. All of these are one byte
in UTF-8, so words are found on the bytes and no Python string is made. Rows are handled in blocks
of a bounded number of bytes; only a single longer text makes a larger block.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.RandomState(20260101).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(3) + np.uint64(1)
FOLDED = VALUES[LOWER]
_POWERS: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a table of at most SLICE_BYTES entries is kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        made = np.full(max(n, 1), base, np.uint64)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint64)
        if n > 2 * SLICE_BYTES:
            return made
        have = _POWERS[int(base)] = made
    return have[:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(name)
    return col.fill_null("") if col.null_count else col


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows of about ``limit`` bytes, each of one row at least."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """64-bit hash of each of the ascending, disjoint byte spans."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + SLICE_BYTES, "right")))
        a, b = int(start[low]), int(end[high - 1])
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[a:b]] * powers(BASE, b - a), out=sums[1:])
        s, e = start[low:high] - a, end[low:high] - a
        out[low:high] = (sums[e] - sums[s]) * powers(INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64)
        low = high
    return mix(out)


class Words:
    """Words of one block of rows: byte spans, row of each word, first word of each row. ``outside`` marks the
    one-byte characters that no word holds."""

    def __init__(self, data: np.ndarray, at: np.ndarray, low: int, high: int, outside: np.ndarray = SPACE):
        a, b = int(at[low]), int(at[high])
        self.data, self.rows = data, high - low
        self.row_start, self.row_end = at[low:high], at[low + 1:high + 1]
        inside = ~outside[data[a:b]]
        edge = np.zeros(b - a + 1, bool)  # a row's end also ends a word
        edge[(at[low:high + 1] - a)] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins) + a
        self.end = np.flatnonzero(ends) + a + 1
        self.first = np.searchsorted(self.start, at[low:high + 1])
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def hashes(self, fold: bool = False) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end, FOLDED if fold else VALUES)


def windows_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; the caller drops runs that cross rows."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * BASE + h[j:j + n]
    return mix(out)


def windows_valid(row: np.ndarray, size: int) -> np.ndarray:
    n = len(row) - size + 1
    return row[size - 1:] == row[:n] if n > 0 else np.zeros(0, bool)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(keys), bool)
    hit[:-1] |= same
    hit[1:] |= same
    out = np.empty(len(keys), bool)
    out[order] = hit
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Marks the positions 0..n-1 that a run of ``size`` from one of the starts covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0
