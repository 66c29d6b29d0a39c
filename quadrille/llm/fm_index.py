"""A compressed FM-index over integer texts: wavelet-matrix ranks and vectorised backward search.

Built for one shard at a time: several texts of word numbers are joined with separators, the suffixes are
ordered to a fixed depth by prefix doubling, and the Burrows-Wheeler transform is kept as a wavelet matrix of
packed bits with block counts.  All queries advance together, one symbol a step.
"""

from __future__ import annotations

import numpy as np



def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols (the text is taken as a cycle)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth:
        key = rank * n + np.roll(rank, -reach)
        order = np.argsort(key)
        by = key[order]
        step = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        reach *= 2
        if step[-1] == n - 1:
            break
    return order


class WaveletMatrix:
    """rank(symbol, i): occurrences of symbol in values[:i], for arrays of queries."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.bits = len(values), max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        v = values
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])
        self.start = self._starts(sigma)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            block = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[k][block] + np.bitwise_count(self.words[k][block] & mask)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def _starts(self, sigma: int) -> np.ndarray:
        return self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(symbol, i) - self.start[symbol]


class FMIndex:
    """texts: arrays of symbols >= 1; owner[t] is an order number of text t, of which intervals report the least."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int):
        n = int(lengths.sum()) + len(lengths)
        text = np.zeros(n, dtype=np.int64)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
        text[place] = flat
        self.sigma = int(flat.max(initial=0)) + 1
        order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        who = np.repeat(owner, lengths + 1)[order].astype(np.int32)
        self.least = [who]  # sparse table of minima
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.n = n

    def prepend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of symbol + pattern from that of pattern."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each non-empty interval."""
        width = high - low
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.least[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return out


def earlier_windows(index: FMIndex, flat: np.ndarray, lengths: np.ndarray, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, start, end): word ranges made of windows of `width` words that a text with owner below limit[stream] holds.

    Every stream keeps the window starts A..B that are still open and alternates two backward searches.  One
    runs from the end of the last open window; where it fails at word f, all windows after f match.
    The other runs from the end of a group of windows at A and, failing, drops all windows over the
    unmatched piece at once; its group grows while it succeeds."""
    base = np.cumsum(lengths) - lengths
    a, b = np.zeros(len(lengths), np.int64), lengths - width
    left = np.zeros(len(lengths), dtype=bool)
    group = np.zeros(len(lengths), np.int64)
    live = np.flatnonzero(b >= 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    end = b + width
    pos, low, high = end.copy(), np.zeros(len(lengths), np.int64), np.full(len(lengths), index.n, np.int64)
    while len(live):
        sym = flat[base[live] + pos[live] - 1]
        lo, hi = index.prepend(sym, low[live], high[live])
        ok = hi > lo
        at = np.flatnonzero(ok)
        ok[at] = index.least_owner(lo[at], hi[at]) < limit[live[at]]
        go = live[ok]
        low[go], high[go] = lo[ok], hi[ok]
        pos[go] -= 1
        won = go[pos[go] == a[go]]
        lost = live[~ok]
        if len(won):
            out.append((won, a[won], end[won]))
            a[won] = end[won] - width + 1
            group[won] = np.where(left[won], 2 * group[won] + 1, 0)
            left[won] = True
        if len(lost):
            f = pos[lost] - 1
            long = end[lost] - pos[lost] >= width
            hit = lost[long]
            out.append((hit, pos[hit], end[hit]))
            whole, grp = ~left[lost], left[lost] & (group[lost] > 0)
            one = left[lost] & (group[lost] == 0)
            b[lost[whole]] = np.where(long[whole], f[whole], b[lost[whole]] - 1)
            left[lost[whole & ~long]] = True
            group[lost[whole]] = 0
            group[lost[grp]] //= 2
            a[lost[one]] = f[one] + 1
            left[lost[one]] = False
        both = np.concatenate([won, lost])
        if len(both):
            group[both] = np.minimum(group[both], np.maximum(b[both] - a[both], 0))
            end[both] = np.where(left[both], a[both] + group[both], b[both]) + width
            pos[both] = end[both]
            low[both], high[both] = 0, index.n
            live = live[a[live] <= b[live]]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))
