"""An FM-index over a sequence of numbers, in numpy: suffix order, wavelet-tree ranks,
backward search of many phrases at once, and locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many places the position of a suffix is kept.
STEP = 16


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The places of s by the suffixes that start there.

    0 parts texts and s ends with 0; a suffix is compared up to its first 0, and of equal
    ones the earlier place comes first, as if every 0 were a symbol of its own.  As many
    symbols as fit in 62 bits are sorted at once, then what is equal by doubled lengths.  s has
    fewer than 2^31 places."""
    n, bits = len(s), max(int(s.max()).bit_length(), 1)
    depth = max(1, min(62 // bits, n))
    key, going = s.astype(np.int64), s > 0
    for k in range(1, depth):
        following = np.zeros(n, np.int64)
        following[: n - k] = s[k:]
        following[~going] = 0
        key = (key << bits) | following
        going = following > 0
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    open_ = going[order]  # no 0 yet: equal keys are not equal suffixes
    heads = np.maximum.accumulate(np.where(first | ~open_, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    del key, going
    same = np.zeros(n, bool)
    same[1:] = heads[1:] == heads[:-1]
    same[:-1] |= same[1:]
    at = np.flatnonzero(same)  # rows whose suffixes are still equal
    while len(at):
        places, head = order[at], rank[order[at]]
        nxt = rank[places + depth]
        sort = np.argsort(head << 32 | nxt)
        places, head, nxt = places[sort], head[sort], nxt[sort]
        order[at] = places
        first = np.ones(len(at), bool)
        first[1:] = (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])
        head = np.maximum.accumulate(np.where(first, at, 0))
        rank[places] = head
        same = ~first
        same[:-1] |= ~first[1:]
        at = at[same]
        depth *= 2
    return order


class Bits:
    """A bit vector with rank: words of 64 bits and the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and locates phrases in s, whose symbols are 1 to n_symbols; 0 parts texts."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        order = suffix_order(s)
        self.n, self.depth = len(s), max(int(n_symbols).bit_length(), 1)
        last = s[order - 1]  # what stands before each suffix; before the first one, the closing 0
        starts = np.zeros(self.n, bool)
        starts[0] = True
        starts[1:] = s[:-1] == 0
        kept = starts | (np.arange(self.n) % STEP == 0)
        self.marked = Bits(kept[order])
        self.places = order[kept[order]]
        del order
        counts = np.zeros(n_symbols + 2, np.int64)
        counts[1:] = np.cumsum(np.bincount(s, minlength=n_symbols + 1))
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            ones = (last >> level & 1).astype(bool)
            zeros = self.n - int(ones.sum())
            self.levels.append((Bits(ones), zeros))
            last = np.concatenate([last[~ones], last[ones]])
        symbols = np.arange(n_symbols + 1)
        #: From a place among a symbol's bits at the tree's bottom to a row of the suffix order.
        self.shift = counts[:-1] - self._down(symbols, np.zeros(n_symbols + 1, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.rank(i)
            i = np.where(symbols >> level & 1, zeros + ones, i - ones)
        return i

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row behind the last) of the suffixes that begin with each row of phrases;
        equal where there is none.  Symbols are added from the last to the first, and phrases
        without a suffix left are not searched on."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = a = self._down(c, low[alive]) + self.shift[c]
            high[alive] = b = self._down(c, high[alive]) + self.shift[c]
            alive = alive[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: steps back to the next kept one are counted."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, i = np.arange(len(rows)), rows.astype(np.int64)
        while len(at):
            here = self.marked.get(i)
            out[at[here]] = self.places[self.marked.rank(i[here])] + steps
            at, i, steps = at[~here], i[~here], steps + 1
            c = np.zeros(len(i), np.int64)
            for bits, zeros in self.levels:
                one, ones = bits.get(i), bits.rank(i)
                c = c << 1 | one
                i = np.where(one, zeros + ones, i - ones)
            i = i + self.shift[c]
        return out
