"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table, partitioned by documents: each slice of documents is one row with a sorted term
dictionary and, per term, the ascending positions of all its tokens (as differences).  It is written once to the
shared folder and every search reads it: a phrase starts from its rarest term's postings and intersects the
offset-adjusted postings of the other terms, rarest first, so that a phrase with an absent term costs one probe.
Nothing is shuffled.

The test set is broadcast in blocks of at most `BLOCK_BYTES` of text (`query_blocks`), one at a time; a larger test
set is more searches of the stored index, and the hits of a row of documents are merged by its place in the index.
The answer is the same for any number of blocks.

Cases: a null or empty text has no words (0 words, 0 hits); an item without words has no window;
repeated items each count as an item; rows with a null item_id are no items; rows that repeat a doc_id are each judged by their own text; a very long
text is a slice of its own and indexed whole; an empty table or an empty test set gives no hits; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark, _text

BLOCK_BYTES = 4 << 20
INDEX = "shard string, doc_ids binary, first_word binary, terms binary, ptr binary, postings binary"


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice and each document's first word."""
    low = _text.lower_table()[data]
    starts, ends, first = _text.words(low, offsets, _text.alnum_table())
    return _text.word_hashes(low, starts, ends), first


def build_index(docs: DataFrame) -> DataFrame:
    """One positional inverted index per slice of (doc_id, text); every token of every text is in it.

    `shard` is drawn anew whenever a row is computed: search a stored index (`store_index`), not this plan."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            h, first = token_hashes(data, offsets)
            order = np.argsort(h, kind="stable")
            by = h[order]
            ptr = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), by[1:] != by[:-1]]))
            ids = np.array([-(1 << 63) if i is None else i for i in part.column(0).to_pylist()], dtype=np.int64)
            gaps = np.diff(order, prepend=0)
            gaps[ptr] = order[ptr]
            blob = [ids, first.astype(np.int32), by[ptr], np.append(ptr, len(by)).astype(np.int32), gaps.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x.tobytes()], pa.binary()) for x in blob)], names=[c.split()[0] for c in INDEX.split(", ")])

    return _spark.texts(docs).mapInArrow(run, INDEX)


def store_index(docs: DataFrame) -> DataFrame:
    """The index as a table in the shared folder; `_spark.discard` deletes it."""
    return _spark.materialise(build_index(docs), "phrase-index", "zstd", 8)


@dataclass
class Queries:
    """Distinct phrases and the items of each: `terms` are sorted, `rows` gives the terms of a phrase, padded beyond its length."""

    terms: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    item_ptr: np.ndarray
    items: list[str]


def compile_windows(items: list[tuple[object, str | None]], width: int = 10) -> Queries:
    """All runs of `width` words of each item; an item of fewer words, but not none, is one run."""
    items = [(key, t) for key, t in items if key is not None]
    texts = [(t or "").encode() for _, t in items]
    offsets = np.cumsum([0, *map(len, texts)])
    h, first = token_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    owner: dict[tuple[int, ...], set[str]] = {}
    for (key, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist()):
        row = h[a:b].tolist()
        for i in range(max(1, len(row) - width + 1) if row else 0):
            owner.setdefault(tuple(row[i : i + width]), set()).add(str(key))
    lengths = np.array([len(w) for w in owner], dtype=np.int64)
    terms = np.zeros((len(owner), max(lengths, default=1)), dtype=np.uint64)
    for i, w in enumerate(owner):
        terms[i, : len(w)] = w
    names = [sorted(v) for v in owner.values()]
    distinct, back = np.unique(terms, return_inverse=True)
    return Queries(distinct, back.reshape(terms.shape), lengths, np.cumsum([0, *map(len, names)]), [x for v in names for x in v])


class Shard:
    """The postings of one index row."""

    def __init__(self, doc_ids, first_word, terms, ptr, postings):
        self.doc_ids = np.frombuffer(doc_ids, np.int64)
        self.first = np.frombuffer(first_word, np.int32).astype(np.int64)
        self.terms, self.ptr = np.frombuffer(terms, np.uint64), np.frombuffer(ptr, np.int32).astype(np.int64)
        gaps = np.frombuffer(postings, np.int32).astype(np.int64)
        total, start = np.cumsum(gaps), self.ptr[:-1]
        self.postings = total - np.repeat(total[start] - gaps[start], np.diff(self.ptr))
        self.n = len(self.postings)
        self._joint: np.ndarray | None = None

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Indexes of terms, -1 where absent."""
        if not len(self.terms):
            return np.full(terms.shape, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def document_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def contains(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether position is in term's postings, by search in the (term, position) order."""
        if self._joint is None:
            self._joint = np.repeat(np.arange(len(self.terms)), np.diff(self.ptr)) * (self.n + 1) + self.postings
        key = term * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self._joint, key), self.n - 1)
        return (self._joint[at] == key) & (position >= 0) & (position < self.n)

    def phrases(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(start position, phrase) of every exact occurrence."""
        none = np.zeros(0, np.int64)
        if not self.n or not len(q.lengths):
            return none, none
        used = np.arange(q.rows.shape[1]) < q.lengths[:, None]
        ids = np.where(used, self.find(q.terms)[q.rows], 0)
        here = np.flatnonzero((ids >= 0).all(axis=1))
        if not len(here):
            return none, none
        ids, used = ids[here], used[here]
        count = np.where(used, (self.ptr[1:] - self.ptr[:-1])[ids], np.iinfo(np.int64).max)
        rank = np.argsort(count, axis=1, kind="stable")  # rarest term first
        rows = np.arange(len(here))
        lead = rank[:, 0]
        size = count[rows, lead]
        begin = self.ptr[ids[rows, lead]]
        phrase = np.repeat(rows, size)
        start = self.postings[_text.ranges(begin, size)] - lead[phrase]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        length = q.lengths[here]
        doc = self.document_of(start)
        ok = (start + length[phrase] <= self.first[doc + 1])
        phrase, start = phrase[ok], start[ok]
        for k in range(1, rank.shape[1]):
            if not len(phrase):
                break
            col = rank[phrase, k]
            need = used[phrase, col]
            ok = ~need
            at = np.flatnonzero(need)
            ok[at] = self.contains(ids[phrase[at], col[at]], start[at] + col[at])
            phrase, start = phrase[ok], start[ok]
        return start, here[phrase]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within `slop` words in the same document."""
        ids = self.find(np.unique(terms))
        if not self.n or not len(ids) or (ids < 0).any():
            return np.zeros(0, np.int64)
        ids = ids[np.argsort((self.ptr[1:] - self.ptr[:-1])[ids], kind="stable")]
        at = self.postings[self.ptr[ids[0]] : self.ptr[ids[0] + 1]]
        doc = self.document_of(at)
        for t in ids[1:]:
            post = self.postings[self.ptr[t] : self.ptr[t + 1]]
            low, high = np.maximum(at - slop, self.first[doc]), np.minimum(at + slop + 1, self.first[doc + 1])
            ok = np.searchsorted(post, low) < np.searchsorted(post, high)
            at, doc = at[ok], doc[ok]
        return at


def query_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The (item_id, text) rows in blocks of about `block_bytes` of text, one block on the driver at a time."""
    items = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)) == b)
        yield [(r[0], r[1]) for r in part.collect()]


HITS = "shard string, row int, doc_id long, n_words long, hits array<long>, item_ids array<string>"


def search(index: DataFrame, queries: Broadcast, rows_without_hits: bool = True) -> DataFrame:
    """Per row of the indexed documents: its number of words, the hit word positions (ascending), the items found (sorted)."""
    def run(batches):
        q = queries.value
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                s = Shard(*row)
                n = len(s.doc_ids)
                start, phrase = s.phrases(q)
                edge = np.bincount(start, minlength=s.n + 1) - np.bincount(start + q.lengths[phrase], minlength=s.n + 1)
                hit = np.flatnonzero(np.cumsum(edge)[: s.n] > 0)
                bounds = np.searchsorted(hit, s.first)
                found: list[list[str]] = [[] for _ in range(n)]
                size = np.diff(q.item_ptr)[phrase]
                who = np.unique(np.repeat(s.document_of(start), size) * (len(q.items) + 1) + _text.ranges(q.item_ptr[phrase], size))
                for d, i in zip(*(x.tolist() for x in np.divmod(who, len(q.items) + 1))):
                    found[d].append(q.items[i])
                out = pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(s.doc_ids, mask=s.doc_ids == -(1 << 63)), pa.array(np.diff(s.first)),
                     _text.ragged(hit - np.repeat(s.first[:-1], np.diff(bounds)), bounds, pa.int64()), pa.array([sorted(set(f)) for f in found], pa.list_(pa.string()))],
                    names=[c.split()[0] for c in HITS.split(", ")])
                yield out if rows_without_hits else out.filter(pa.array(np.diff(bounds) > 0))

    return index.mapInArrow(run, HITS)


def proximity(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc_id, position) of the rarest of `terms` wherever all the others stand within `slop` words of it."""
    raw = [t.encode() for t in terms]
    h, _ = token_hashes(np.frombuffer(b" ".join(raw), dtype=np.uint8), np.array([0, len(b" ".join(raw))]))

    def run(batches):
        for batch in batches:
            for _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                s = Shard(*row)
                at = s.near(h, slop)
                doc = s.document_of(at)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[doc]), pa.array(at - s.first[doc])], names=["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def phrase_hits(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, item_ids) of every row of `docs`: exact hits of all windows of `items`, over as many blocks of items as their size needs."""
    index = store_index(docs)
    parts = []
    for block in query_blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(compile_windows(block, width))
        parts.append(_spark.materialise(search(index, shared, not parts), "phrase-hits"))
        shared.destroy()
    _spark.discard(index)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("shard", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merge("hits"), merge("item_ids"))
    return out.select("doc_id", "n_words", "hits", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    hits = phrase_hits(docs, items, width, block_bytes)
    n = F.size("hits").cast("long")
    return hits.select("doc_id", "n_words", n.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
