"""Ranked lexical search, score at a time over an impact-ordered index.

A document's part of a score for a term, its impact, is a whole number that its counts and length fix; the term's weight
multiplies it.  The index is a stored table, partitioned by documents: each slice of documents is one row with a sorted
term dictionary, and a term's postings are grouped by exact impact, greatest first.  A query takes the groups of all
its terms in descending order of weight times impact and adds them up.  What a document can still gain is at most the sum of
the terms' next groups; when this bound proves that only a few documents can be among the best, the scores of
these are completed from the postings by document, and the rest is left unread.  A task keeps each query's best
documents so far, so that later shards begin with a threshold.  Every document is searched for every query; the result is exact.

The numbers of documents and terms come from a first pass over all texts, document frequencies from the index's dictionaries.  The
queries are broadcast in blocks of at most `BLOCK_BYTES` of text, one at a time.

Cases: null texts, and texts without a term, are no documents of the collection and are never found; items without terms find
nothing; repeated items are ranked each; rows that repeat a doc_id are ranked each by their own text; rows with a null
doc_id come after others of their score; equal scores go by ascending doc_id, whatever the dealing; a very long text is a shard of its own;
extra columns are ignored; an empty table or an empty set of items gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import _spark, _text
from quadrille.llm.byte_runs import find
from quadrille.llm.phrase_index import query_blocks, token_hashes

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
FIRST_STEP = 4096  # postings before the bounds are looked at; doubled each time
FEW = 8  # times k: candidates whose scores are completed
NULL_ID = (1 << 63) - 1
INDEX = "doc_ids binary, terms binary, df binary, groups binary, impacts binary, begins binary, postings binary"
HITS = "query int, doc_id long, score long"


def statistics(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all terms with repeats."""
    def run(batches):
        for _, data, offsets in _text.slices(batches):
            n = np.diff(_text.words(_text.lower_table()[data], offsets, _text.alnum_table())[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    got = _spark.texts(docs).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def impacts_of(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """The impact of a term that stands tf times in a document of n terms."""
    m = 25 + 75 * n * total_docs // max(total_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, total_docs: int, total_terms: int) -> DataFrame:
    """One impact-ordered index per slice of (doc_id, text)."""
    def run(batches):
        for part, data, offsets in _text.slices(batches, limit=SHARD_BYTES):
            h, first = token_hashes(data, offsets)
            size = np.diff(first)
            terms, at = np.unique(h, return_inverse=True)
            pair, tf = np.unique(at * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
            term, doc = np.divmod(pair, max(len(size), 1))
            impact = impacts_of(tf, size[doc], total_docs, total_terms)
            by = np.argsort((term << 20) - impact, kind="stable")  # impacts are below 10^6; within a group documents ascend
            term, impact, doc = term[by], impact[by], doc[by]
            fresh = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
            ids = np.array([NULL_ID if i is None else i for i in part.column(0).to_pylist()], dtype=np.int64)
            df = np.bincount(term, minlength=len(terms))
            groups = np.searchsorted(term[fresh], np.arange(len(terms) + 1))
            blob = [ids, terms, df.astype(np.int64), groups.astype(np.int32), impact[fresh].astype(np.int32), np.append(fresh, len(term)).astype(np.int32), doc.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blob], names=[c.split()[0] for c in INDEX.split(", ")])

    return _spark.texts(docs).mapInArrow(run, INDEX)


def store_index(docs: DataFrame, total_docs: int, total_terms: int) -> DataFrame:
    """The index as a table in the shared folder, a shard a row group."""
    return _spark.materialise(build_index(docs, total_docs, total_terms), "impact-index", "zstd", 1)


@dataclass
class Queries:
    """Distinct terms and, for each query, its terms, how often it has them, and where they begin."""

    terms: np.ndarray
    of: np.ndarray
    count: np.ndarray
    first: np.ndarray
    weight: np.ndarray | None = None


def compile_queries(texts: list[str | None]) -> Queries:
    raw = [(t or "").encode() for t in texts]
    h, first = token_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    terms, at = np.unique(h, return_inverse=True)
    pair, count = np.unique(np.repeat(np.arange(len(raw)), np.diff(first)) * max(len(terms), 1) + at, return_counts=True)
    query, of = np.divmod(pair, max(len(terms), 1))
    return Queries(terms, of, count, np.searchsorted(query, np.arange(len(raw) + 1)))


def weigh(index: DataFrame, q: Queries, total_docs: int) -> None:
    """Set the weights of the queries' terms from the document frequencies in the index's dictionaries."""
    wanted = index.sparkSession.sparkContext.broadcast(q.terms)

    def run(batches):
        total = np.zeros(len(wanted.value), dtype=np.int64)
        for batch in batches:
            for terms, df in zip(*(c.to_pylist() for c in batch.columns)):
                known, at = find(np.frombuffer(terms, np.uint64), wanted.value)
                total[known] += np.frombuffer(df, np.int64)[at[known]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(len(q.terms))
    for r in index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms at most
        df[r.term] = r.df
    wanted.destroy()
    q.weight = np.floor(1000 * np.log((2 * total_docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """One row of the index."""

    def __init__(self, doc_ids, terms, groups, impacts, begins, postings):
        self.ids, self.terms = np.frombuffer(doc_ids, np.int64), np.frombuffer(terms, np.uint64)
        self.groups, self.begins = np.frombuffer(groups, np.int32).astype(np.int64), np.frombuffer(begins, np.int32).astype(np.int64)
        self.impacts, self.postings = np.frombuffer(impacts, np.int32).astype(np.int64), np.frombuffer(postings, np.int32)
        self._by_document = None

    def impact(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The impact of each term in each document, 0 where the document lacks it."""
        if self._by_document is None:
            size = np.diff(self.begins)
            key = np.repeat(np.repeat(np.arange(len(self.terms)), np.diff(self.groups)), size) * len(self.ids) + self.postings
            order = np.argsort(key, kind="stable")
            self._by_document = key[order], np.repeat(self.impacts, size)[order]
        keys, values = self._by_document
        known, at = find(keys, (term[:, None] * len(self.ids) + doc[None, :]).ravel())
        return np.where(known, values[at], 0).reshape(len(term), len(doc))

    def best(self, term: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that can be among the k best, given that a score below `least` can't."""
        none = np.zeros(0, np.int64)
        first = self.groups[term]
        number = self.groups[term + 1] - first
        if not len(term) or int((weight * self.impacts[first]).sum()) < least:
            return none, none
        group = _text.ranges(first, number)
        of = np.repeat(np.arange(len(term)), number)
        gain = weight[of] * self.impacts[group]
        order = np.argsort(-gain, kind="stable")
        group, of, gain = group[order], of[order], gain[order]
        size = self.begins[group + 1] - self.begins[group]
        read = np.cumsum(size)
        score = np.zeros(len(self.ids), dtype=np.int64)
        a, step = 0, FIRST_STEP
        while a < len(group):
            b = max(a + 1, int(np.searchsorted(read, step, side="right")))
            step *= 2
            np.add.at(score, self.postings[_text.ranges(self.begins[group[a:b]], size[a:b])], np.repeat(gain[a:b], size[a:b]))
            a = b
            if a == len(group):
                break
            done = np.bincount(of[:a], minlength=len(term))
            left = np.flatnonzero(done < number)
            bound = int((weight[left] * self.impacts[first[left] + done[left]]).sum())
            least = max(least, int(np.partition(score, -k)[-k])) if len(score) > k else least
            if bound < least:  # no document outside those touched can come in
                found = np.flatnonzero(score + bound >= least)
                if len(found) <= FEW * k:
                    return found, (self.impact(term, found) * weight[:, None]).sum(axis=0)
        least = max(least, 1, int(np.partition(score, -k)[-k]) if len(score) > k else 0)
        found = np.flatnonzero(score >= least)
        return found, score[found]


def search(index: DataFrame, queries: Broadcast, k: int) -> DataFrame:
    """For each query the k best documents of each task's shards: (query, doc_id, score)."""
    def run(batches):
        q = queries.value
        n = len(q.first) - 1
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(*row)
                known, place = find(shard.terms, q.terms)
                for i in range(n):
                    of = slice(q.first[i], q.first[i + 1])
                    term, weight = q.of[of], q.count[of] * q.weight[q.of[of]]
                    keep = known[term] & (weight > 0)
                    scores, ids = best[i]
                    doc, score = shard.best(place[term[keep]], weight[keep], k, int(scores[-1]) if len(scores) == k else 1)
                    if len(doc):
                        scores, ids = np.concatenate([scores, score]), np.concatenate([ids, shard.ids[doc]])
                        top = np.lexsort((ids, -scores))[:k]
                        best[i] = scores[top], ids[top]
        size = [len(s) for s, _ in best]
        ids = np.concatenate([np.zeros(0, np.int64), *(d for _, d in best)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), size)), pa.array(ids, mask=ids == NULL_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for s, _ in best)]))], names=["query", "doc_id", "score"])

    return index.drop("df").mapInArrow(run, HITS)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    total_docs, total_terms = statistics(docs)
    index = store_index(docs, total_docs, total_terms)
    parts = []
    before = 0
    for block in query_blocks(items, block_bytes):
        q = compile_queries([t for _, t in block])
        weigh(index, q, total_docs)
        shared = spark.sparkContext.broadcast(q)
        names = spark.createDataFrame([(i, before + i, item) for i, (item, _) in enumerate(block)], f"query int, number int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(_spark.materialise(search(index, shared, k).join(F.broadcast(names), "query").drop("query"), "ranked-hits"))
        shared.destroy()
        before += len(block)
    _spark.discard(index)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
