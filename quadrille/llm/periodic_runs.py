"""Periodic runs of words, found from Lyndon words.

A run is a stretch of words with a smallest period q, at least 2 q long, that no neighbouring word extends.  Under one
of two orders of the words (any order, and its reverse) each run begins its period with a Lyndon word that is the longest one
at its place.  So a stack is scanned from right to left under both orders: it holds the begins of the Lyndon words that follow,
and a suffix that is less than the suffix at the top takes that word into its own.  Suffixes are compared, and the
longest Lyndon words extended in both directions, by their longest common extension: a binary search over rolling hashes,
whose answer is then verified word for word.  Stretches whose words are known to be equal q apart are remembered for each
distance, so that no stretch of a distance is searched or verified twice.  There is no suffix array.

Words are the maximal stretches without ASCII white space, compared by all their bytes.  A text is one row of one task: time is
n log n in its words at worst and memory in proportion to them.

Cases: null, empty and white texts have no words and no run; a text of one word over and over is one run of period 1; of runs
that overlap each counts; repeated rows, and rows that share a doc_id or have none, are each judged by themselves; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm import _spark, _text

SHORTEST = 12
_MASK = (1 << 64) - 1
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Extensions:
    """Longest common extensions between the places of one sequence of numbers."""

    def __init__(self, seq: np.ndarray):
        self.seq, self.n = seq, len(seq)
        self.at = memoryview(seq)
        up, _ = _text._WORDS.get(self.n + 1)
        acc = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_text.mix(seq.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=acc[1:])
        self.acc, self.up = memoryview(acc), memoryview(up)
        self.equal: dict[int, tuple[int, int]] = {}  # by distance d: where seq[k] == seq[k + d], maximal to the right

    def _same(self, a: int, b: int, m: int) -> bool:
        """Whether the m numbers from a and from b on (a < b) have one hash."""
        acc = self.acc
        return not ((acc[a + m] - acc[a]) * self.up[b - a] - acc[b + m] + acc[b]) & _MASK

    def right(self, i: int, j: int) -> int:
        """The number of equal words from i and from j on (i < j)."""
        d = j - i
        known = self.equal.get(d)
        if known:
            if known[0] <= i <= known[1]:
                return known[1] - i
            if i + 1 == known[0] and self.at[i] == self.at[j]:
                self.equal[d] = (i, known[1])
                return known[1] - i
        most = self.n - j
        low, high = 0, 1
        while high <= most and self._same(i, j, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            m = (low + high) // 2
            low, high = (m, high) if self._same(i, j, m) else (low, m)
        if low:
            differ = self.seq[i : i + low] != self.seq[j : j + low]
            if differ.any():  # two hashes met by chance
                low = int(differ.argmax())
        self.equal[d] = (i, i + low)
        return low

    def left(self, i: int, j: int) -> int:
        """The number of equal words before i and before j (i < j)."""
        low, high = 0, 1
        while high <= i and self._same(i - high, j - high, high):
            low, high = high, 2 * high
        high = min(high, i + 1)
        while high - low > 1:
            m = (low + high) // 2
            low, high = (m, high) if self._same(i - m, j - m, m) else (low, m)
        if low:
            differ = self.seq[i - low : i] != self.seq[j - low : j]
            if differ.any():
                low = int(differ[::-1].argmax())
        return low


def lyndon_ends(order: list[int], ext: Extensions) -> np.ndarray:
    """The end of the longest Lyndon word that begins at each place, under an order of the words given as numbers."""
    n = len(order)
    order = [*order, -1]  # the end of the text is less than any word
    under = [n] * n  # what lies under each place on the stack: the end of its word
    right = ext.right
    for i in range(n - 1, -1, -1):
        a, j = order[i], i + 1
        while True:
            b = order[j]
            if a > b:
                break
            if a == b:
                a, b = order[i + 1], order[j + 1]
                if a > b:
                    break
                if a == b:
                    same = right(i, j)
                    if order[i + same] > order[j + same]:
                        break
                a = order[i]
            j = under[j]
        under[i] = j
    return np.array(under, dtype=np.int64)


def find_runs(seq: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `shortest` words, ascending."""
    n = len(seq)
    if n < max(shortest, 2):
        return []
    ext = Extensions(seq)
    at = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    seen: dict[int, tuple[int, int]] = {}
    side = -(-shortest // 4)
    padded = np.append(seq, np.full(side + 1, -1))
    for order in (seq, int(seq.max()) - seq):
        ends = lyndon_ends(order.tolist(), ext)
        period = ends - at
        # a run has shortest / 2 equal pairs or more, so a quarter of `shortest` on one side of the place
        after, before = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        for k in range(side):
            after &= padded[np.minimum(ends + k, n + 1)] == padded[at + k]
            before[k + 1 :] &= seq[: n - k - 1] == seq[ends[k + 1 :] - k - 1]
            before[: k + 1] = False
        extends = after | before
        for i in np.flatnonzero(extends & (2 * period <= n))[::-1].tolist():
            p = int(period[i])
            known = seen.get(p)
            if known and known[0] <= i <= known[1]:
                continue
            low = i - ext.left(i, i + p)
            high = i + ext.right(i, i + p) if i + p < n else i
            seen[p] = (low, high)
            if high - low >= p and high - low + p >= shortest:
                found.add((low, high - low + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words only."""
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs).T
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text with each run cut to its first period, words joined by spaces."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            raw = data.tobytes()
            counts, every, texts = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = raw[a:b].split()  # at ASCII white space
                got = find_runs(numbered(words), shortest)
                counts.append(len(words))
                every.append(got)
                texts.append(b" ".join(collapsed(words, got)).decode())
            flat = np.array([r for got in every for r in got], dtype=np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
            bounds = pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(bounds, rows), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return _spark.texts(docs).mapInArrow(run, RUNS)
