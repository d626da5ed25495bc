"""An FM-index (Ferragina and Manzini, 2000) over a sequence of symbols, with a wavelet matrix for ranks, in numpy.

Symbol 0 is a separator; each separator differs from all others and is less than any symbol, in order of position. So
suffixes compare as far as the next separator at most. Sequences start and end with a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling over groups that are still equal."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols.astype(np.int64) + int(breaks.sum()))
    order = np.argsort(rank, kind="stable")
    rank = _ranked(order, rank[order])
    width, todo = 1, np.arange(n)  # todo: places in the order whose suffixes aren't alone with their rank
    while True:
        r = rank[order[todo]]
        same = np.concatenate(([False], r[1:] == r[:-1])) | np.concatenate((r[1:] == r[:-1], [False]))
        todo, r = todo[same], r[same]
        if not len(todo):
            return order
        at = order[todo]
        # A suffix that isn't alone has no separator in its first ``width`` symbols, so there is a symbol at + width.
        after = rank[at + width]
        by = np.lexsort((after, r))
        at, r, after = at[by], r[by], after[by]
        order[todo] = at
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (after[1:] != after[:-1])))
        place = np.maximum.accumulate(np.where(new, todo, 0))
        rank[at] = place
        width *= 2


def _ranked(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    new = np.concatenate(([True], value[1:] != value[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts for each bit of a symbol, highest first."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        lo, hi = np.zeros(len(end), np.int64), end.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo


class FMIndex:
    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_order(symbols)
        self.last = np.where(order > 0, symbols[order - 1], 0)
        self.ranks = WaveletMatrix(self.last, largest)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))
        # Sampled positions: one in SAMPLE, and those after a separator, where no step back is defined.
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.kept, self.kept_before, self.positions = kept, np.concatenate(([0], np.cumsum(kept))), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [first, end) of the order whose suffixes start with each phrase: backward search, all at once.

        ``phrases``: symbols, each row right-aligned; none is a separator.
        """
        n, width = phrases.shape
        first, end = np.zeros(n, np.int64), np.full(n, len(self.last), np.int64)
        for j in range(width - 1, -1, -1):
            on = np.flatnonzero((lengths >= width - j) & (first < end))
            c = phrases[on, j]
            first[on] = self.less[c] + self.ranks.rank(c, first[on])
            end[on] = self.less[c] + self.ranks.rank(c, end[on])
        return first, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places of the order: steps back to a sampled one."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.kept[r]
            out[open_[done]] = self.positions[self.kept_before[r[done]]] + steps
            open_, r = open_[~done], r[~done]
            c = self.last[r]
            rows[open_] = self.less[c] + self.ranks.rank(c, r)
            steps += 1
        return out
