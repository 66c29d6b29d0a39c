"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbols.  In every round each still-active sequence finds
its lowest-ranked adjacent pair and all its non-overlapping occurrences are merged, for all sequences
of the batch at once; a sequence without a ranked pair is finished and its surviving symbols counted.
Equal pre-tokens are merged once per batch and kept in a bounded cache of the worker.

Cases: null and empty texts count 0 tokens; ties in rank cannot occur (ranks are unique) and
overlapping occurrences of one pair merge from the left; repeated rows are counted each; extra
columns are ignored; an empty table gives an empty result.  The number of rounds grows with a sequence's
length, so a sequence over `LONG` bytes runs its rounds by itself on a linked list, where a round costs only what
it merges; texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quadrille.llm import _text, _spark

LONG = 512
CACHE_WORDS = 400_000
NONE = np.int64(1 << 40)
_SPACE = r"\t-\r \x85\xa0  -     　"
# The split pattern of the byte-level vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if chr(b) not in out):
        out[chr(256 + i)] = b
    return out


class MergeTable:
    """Ranked merges of a byte-level vocabulary as sorted arrays."""

    def __init__(self, keys, ranks, results, byte_ids, size, specials):
        self.keys, self.ranks, self.results = keys, ranks, results
        self.byte_ids, self.size, self.specials = byte_ids, size, specials

    @classmethod
    def load(cls, path: str) -> "MergeTable":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, size = spec["model"]["vocab"], max(spec["model"]["vocab"].values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        ids = np.zeros(256, dtype=np.int64)
        for ch, b in byte_symbols().items():
            ids[b] = vocab[ch]
        return cls(keys[order], order.astype(np.int64), results[order], ids, size, [t["content"] for t in spec.get("added_tokens", [])])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        out = np.zeros(len(tokens), dtype=np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._count_long(tokens[i])
        short = np.flatnonzero(lengths <= LONG)
        raw = np.frombuffer(b"".join(tokens[i] for i in short), dtype=np.uint8)
        self._merge_rounds(self.byte_ids[raw], lengths[short], short, out)
        return out

    def _merge_rounds(self, sym: np.ndarray, lengths: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        out[owner[lengths < 2]] = lengths[lengths < 2]
        sym, lengths, owner = sym[np.repeat(lengths >= 2, lengths)], lengths[lengths >= 2], owner[lengths >= 2]
        rank, at = np.zeros(0, np.int64), None
        fresh = True
        while len(owner):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            if fresh:
                rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
                rank[:-1], at[:-1] = self.lookup(sym[:-1], sym[1:])
                rank[ends - 1] = NONE
                fresh = False
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                out[owner[done]] = lengths[done]
                live = np.repeat(~done, lengths)
                sym, rank, at = sym[live], rank[live], at[live]
                lengths, owner, best = lengths[~done], owner[~done], best[~done]
                if not len(owner):
                    return
            hit = rank == np.repeat(best, lengths)
            pos = np.flatnonzero(hit)
            run = np.ones(len(pos), dtype=bool)
            run[1:] = pos[1:] != pos[:-1] + 1
            head = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - head) % 2 == 0]
            sym[pos] = self.results[at[pos]]
            keep = np.ones(len(sym), dtype=bool)
            keep[pos + 1] = False
            seq = np.repeat(np.arange(len(owner)), lengths)
            lengths = lengths - np.bincount(seq[pos], minlength=len(owner))
            place = np.cumsum(keep) - 1
            sym, rank, at, seq = sym[keep], rank[keep], at[keep], seq[keep]
            # only pairs that touch a merged symbol change
            new = place[pos]
            touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
            nxt = np.minimum(touched + 1, len(sym) - 1)
            r, a = self.lookup(sym[touched], sym[nxt])
            r[(touched + 1 >= len(sym)) | (seq[touched] != seq[nxt])] = NONE
            rank[touched], at[touched] = r, a

    def _count_long(self, token: bytes) -> int:
        """The same rounds over one long sequence as a linked list; a round touches only the pairs that it merges."""
        sym = self.byte_ids[np.frombuffer(token, dtype=np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, at = np.full(n, NONE), np.zeros(n, np.int64)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(where):
            """Look up the pairs that begin at `where` and file them under their ranks."""
            has = after[where] < n
            rank[where[~has]] = NONE
            where = where[has]
            rank[where], at[where] = self.lookup(sym[where], sym[after[where]])
            where = where[rank[where] < NONE]
            where = where[np.argsort(rank[where], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[where])) + 1
            for part in np.split(where, cut) if len(where) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            pos = np.unique(np.concatenate(places.pop(r)))
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            run = np.ones(len(pos), dtype=bool)
            run[1:] = after[pos[:-1]] != pos[1:]
            head = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - head) % 2 == 0]
            gone = after[pos]
            sym[pos], rank[gone] = self.results[at[pos]], NONE
            after[pos] = after[gone]
            inside = after[pos] < n
            before[after[pos[inside]]] = pos[inside]
            left -= len(pos)
            prev = before[pos]
            note(np.unique(np.concatenate([pos, prev[prev >= 0]])))
        return left


_STATE: dict[str, dict] = {}


def count_texts(table: MergeTable, values: list[str], cache: dict[str, int]) -> list[int]:
    """Tokens of each text; added special strings count one token each."""
    find = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, table.specials))) if table.specials else None
    split, extra = [], []
    for text in values:
        parts = special.split(text) if special and any(s in text for s in table.specials) else [text]
        extra.append(len(parts) - 1)
        split.append(find(parts[0]) if len(parts) == 1 else list(chain.from_iterable(map(find, parts))))
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = list(set(chain.from_iterable(split)).difference(cache))
    if new:
        cache.update(zip(new, table.count([w.encode() for w in new]).tolist()))
    get = cache.__getitem__
    return [e + sum(map(get, s)) for s, e in zip(split, extra)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` under the byte-level vocabulary at `tokenizer_path`.

    The vocabulary (a fixed file of about 1.5 MB) is read once on the driver and broadcast."""
    table = docs.sparkSession.sparkContext.broadcast(MergeTable.load(tokenizer_path))

    def run(batches):
        cache = _STATE.setdefault(tokenizer_path, {})
        for part, _, offsets in _text.slices(batches):
            n = count_texts(table.value, [t or "" for t in part.column(1).to_pylist()], cache)
            n = np.array(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _spark.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
