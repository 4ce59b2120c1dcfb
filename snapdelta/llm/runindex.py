"""A run-length index of short texts: a run-compressed Burrows-Wheeler transform with sampled run ends.

Suffixes are sorted by prefix doubling over arrays. Where the transform's symbol stays the same from one row to the next, the
suffix that precedes in the order and the length shared with it follow from the text position before: both move by one. So
only the rows at run heads are sampled, with their neighbour and the length shared, and the statistics of all other positions
are streamed from the sample before them. In repetitive texts runs are long and samples few.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of nine bits in one 64-bit key


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 on."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.empty(len(keys), np.int64)
    new[0] = 1
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new)
    return out


class RunIndex:
    """Index of texts given end to end (``data``) with their lengths. Matches never cross texts."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        texts = len(lengths)
        self.begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        n = int(lengths.sum()) + texts
        symbols = np.zeros(n + _FIRST, np.int16)
        ends = self.begins + lengths
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[:n][inner] = data.astype(np.int16) + 1
        self.n, self.symbols = n, symbols
        self.room = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols left before the end mark
        self.levels: list[tuple[int, np.ndarray]] = []
        order = self._sorted(int(lengths.max(initial=0)) + 1)
        self._sample(order)

    def _sorted(self, longest: int) -> np.ndarray:
        n, symbols = self.n, self.symbols
        keys, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(_FIRST):
            here = np.where(alive, symbols[k : k + n], 0)
            keys = (keys << 9) | here
            alive &= here > 0
        ranks, width = _ranks(keys), _FIRST
        self.levels.append((width, ranks))
        while width < longest:
            after = np.zeros(n, np.int32)
            inside = np.flatnonzero(self.room >= width)
            after[inside] = ranks[inside + width]
            ranks = _ranks((ranks.astype(np.int64) << 32) | after)
            width *= 2
            self.levels.append((width, ranks))
        # Equal suffixes of different texts are in the order of the texts.
        return np.argsort(ranks, kind="stable")

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two positions have in common, from the sorted levels."""
        got = np.zeros(len(a), np.int64)
        for width, ranks in reversed(self.levels):
            x, y = a + got, b + got
            fits = (self.room[a] - got >= width) & (self.room[b] - got >= width)
            same = fits & (ranks[np.where(fits, x, 0)] == ranks[np.where(fits, y, 0)])
            got[same] += width
        for _ in range(_FIRST):
            fits = (self.room[a] > got) & (self.room[b] > got)
            same = fits & (self.symbols[np.where(fits, a + got, 0)] == self.symbols[np.where(fits, b + got, 0)])
            open_ = same
            got[open_] += 1
            if not open_.any():
                break
        return got

    def _sample(self, order: np.ndarray) -> None:
        """Keep run heads only: position, the position before it in the order, and the length shared."""
        transform = self.symbols[order - 1]
        starts = np.zeros(self.n, bool)
        starts[self.begins] = True
        transform[starts[order]] = 0
        head = np.ones(self.n, bool)
        head[1:] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        rows = np.flatnonzero(head)
        self.runs = len(rows)
        position = order[rows]
        before = np.where(rows > 0, order[rows - 1], -1)
        shared = np.zeros(len(rows), np.int64)
        shared[rows > 0] = self._shared(position[rows > 0], before[rows > 0])
        by_position = np.argsort(position)
        self.sample_at, self.sample_before, self.sample_shared = position[by_position], before[by_position], shared[by_position]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, the position before it in suffix order and the length matched there, read off in text order."""
        marked = np.zeros(self.n, np.int64)
        marked[self.sample_at] = np.arange(len(self.sample_at))
        nearest = np.maximum.accumulate(marked)
        gone = np.arange(self.n) - self.sample_at[nearest]
        return self.sample_before[nearest] + gone, np.maximum(self.sample_shared[nearest] - gone, 0)

    def first_occurrences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``length`` symbols, and whether no text before (or place before) holds the same window."""
        other, matched = self.statistics()
        linked = np.flatnonzero(matched >= length)
        root = np.arange(self.n)
        root[linked] = other[linked]
        while True:
            further = root[root[linked]]
            if (further == root[linked]).all():
                break
            root[linked] = further
        least = np.arange(self.n)
        np.minimum.at(least, root[linked], linked)
        windows = np.flatnonzero(self.room >= length)
        return windows, least[root[windows]] == windows
