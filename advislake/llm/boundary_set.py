"""A sorted set of offsets in containers of 65,536 values, with select by rank.

Each container holds the low 16 bits of its values in the smallest of three forms: an array of the
values, a bitmap of 1,024 words, or runs (first value and length). Cumulative cardinalities lead from a
rank to its container; the container's own form gives the value there.
"""
from __future__ import annotations

import numpy as np

SPAN = 1 << 16
WORDS = SPAN >> 6
ARRAY, BITMAP, RUNS = 0, 1, 2
_BYTE_SELECT = np.zeros((256, 8), np.uint8)  # place of the k-th set bit of a byte
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    _BYTE_SELECT[_byte, :len(_set)] = _set


class BoundarySet:
    """The distinct, ascending, non-negative ``values``; empty sets are allowed."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        high = values >> 16
        begin = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(values) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(values)) if len(values) else begin
        self.key = high[begin]
        self.cumulative = np.append(0, end) if len(values) else np.zeros(1, np.int64)
        breaks = np.ones(len(values), bool)
        breaks[1:] = (values[1:] != values[:-1] + 1) | (high[1:] != high[:-1])
        n_runs = np.add.reduceat(breaks, begin) if len(values) else begin
        size = np.stack([2 * (end - begin), np.full(len(begin), SPAN // 8), 4 * n_runs])
        self.kind = size.argmin(axis=0) if len(begin) else np.zeros(0, np.int64)
        self.place = np.zeros(len(begin), np.int64)  # where a container's part of its form's store begins
        low = (values & (SPAN - 1)).astype(np.uint16)
        self._arrays(low, begin, end)
        self._bitmaps(low, begin, end)
        self._runs(low, breaks, begin, end)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def _members(self, kind: int, begin: np.ndarray, end: np.ndarray):
        """Places in the value list of all values in containers of one form, and the containers."""
        mine = np.flatnonzero(self.kind == kind)
        count = (end - begin)[mine]
        skip = np.repeat(begin[mine] - (np.cumsum(count) - count), count)
        return mine, count, np.arange(int(count.sum())) + skip

    def _arrays(self, low, begin, end):
        mine, count, at = self._members(ARRAY, begin, end)
        self.array = low[at]
        self.place[mine] = np.cumsum(count) - count

    def _bitmaps(self, low, begin, end):
        mine, count, at = self._members(BITMAP, begin, end)
        bits = np.zeros((len(mine), SPAN), np.uint8)
        bits[np.repeat(np.arange(len(mine)), count), low[at]] = 1
        self.bitmap = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)
        ones = np.bitwise_count(self.bitmap).astype(np.int64).reshape(len(mine), WORDS)
        # values before each word, counted over all bitmaps, so that one search serves every query
        self.before = np.append(0, np.cumsum(ones.reshape(-1)))
        self.place[mine] = np.arange(len(mine)) * WORDS

    def _runs(self, low, breaks, begin, end):
        mine, count, at = self._members(RUNS, begin, end)
        first = np.flatnonzero(breaks[at])
        self.run_first = low[at][first]
        self.run_before = np.append(first, len(at))  # values before each run, over all run containers
        self.place[mine] = np.cumsum(count) - count

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The value at each 0-based rank; ranks must be below ``len``."""
        rank = np.asarray(rank, np.int64)
        c = np.searchsorted(self.cumulative, rank, "right") - 1
        local, kind, place = rank - self.cumulative[c], self.kind[c], self.place[c]
        low = np.zeros(len(rank), np.int64)
        m = kind == ARRAY
        low[m] = self.array[place[m] + local[m]]
        m = kind == BITMAP
        if m.any():
            wanted = self.before[place[m]] + local[m]
            word = np.searchsorted(self.before, wanted, "right") - 1
            low[m] = ((word - place[m]) << 6) + _select_in_word(self.bitmap[word], wanted - self.before[word])
        m = kind == RUNS
        if m.any():
            wanted = place[m] + local[m]
            run = np.searchsorted(self.run_before, wanted, "right") - 1
            low[m] = self.run_first[run] + (wanted - self.run_before[run])
        return (self.key[c] << 16) + low


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (0-based) of each 64-bit word: its byte by counts, its bit by table."""
    byte = word.view(np.uint8).reshape(-1, 8)
    ones = np.bitwise_count(byte).astype(np.int64)
    upto = np.cumsum(ones, axis=1)
    which = (upto <= k[:, None]).sum(axis=1)
    row = np.arange(len(word))
    before = upto[row, which] - ones[row, which]
    return which * 8 + _BYTE_SELECT[byte[row, which], k - before]
