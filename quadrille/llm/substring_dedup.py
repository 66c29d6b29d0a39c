"""Substring dedup with a compressed FM-index per shard.

A window of `WIDTH` consecutive words is removed where its word sequence also starts in a document with a
smaller doc_id.  Text is sharded by content, not by document: a window's anchor is the least hash among its
runs of `GRAM` words, so equal windows have the same anchor and meet in its shard.  Anchors of one
document only are dropped by a pre-aggregated count; of the rest, each document sends the words of the
consecutive windows that share the anchor.

A shard joins the distinct pieces of its anchors into an FM-index with document numbers and streams every
piece through it: backward search keeps the interval of the words matched so far and the least
document in it, and reports the ranges whose match is at least `WIDTH` words long in a smaller document.
Pieces arrive sorted by anchor, and a shard is closed after `SHARD_WORDS` words at an anchor's end.

An anchor of more than `HOT` pieces isn't brought into one task.  Its equal pieces are aggregated first: all
but the least document lose the whole piece, wherever it stands.  If at most `HOT` distinct pieces are left, they
are a shard like any other, with all places that each has in its least document.  The windows of an anchor with
more distinct pieces (a very common passage in ever new surroundings) are compared by themselves, one row per
distinct piece and window under a 128-bit hash, so that the work stays in proportion to the distinct pieces.

What is removed is known by doc_id, place and a hash of the words there, so that of several texts under one doc_id each
loses only words that it has itself.

Cases: null and short texts have no window; equal windows within one document, or in rows that share a doc_id, aren't removed for each
other; rows that repeat a doc_id with the same text are judged alike, with other texts each by its own words; rows with a null doc_id are neither removed from nor a source; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _bitmap, _spark, _text
from quadrille.llm.fm_index import FMIndex, earlier_windows

WIDTH, GRAM = 50, 16
SHARD_WORDS = 300_000
HOT = 1000


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (a ufunc like minimum) over all runs of w entries."""
    done, out = 1, x
    while done * 2 <= w:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def anchors(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of the stretches of windows of one document with the same least gram.

    Equal windows have the same least gram, whatever surrounds them.  A stretch has at most width - gram
    windows, so that its words are fewer than twice `width`; longer ones (repetitive text) are cut."""
    span = width - gram + 1
    g = _text.run_hashes(h, gram)
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(g, span, np.minimum)
    n = len(low)
    head = np.concatenate([[True], low[1:] != low[:-1]])
    since = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.flatnonzero(since % (width - gram) == 0)
    return at, np.diff(np.append(at, n)), low[at]


def _hashed(data, offsets):
    starts, ends, first = _text.words(data, offsets, _text.space_table())
    return _text.word_hashes(data, starts, ends), first


def span_marks(short: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words [a, b) for each pair, from the words' short hashes."""
    up, down = _text._WORDS.get(len(short) + 1)
    acc = np.zeros(len(short) + 1, dtype=np.uint64)
    np.cumsum(_text.mix(short.astype(np.uint64) + np.uint64(9)) * up[: len(short)], out=acc[1:])
    return _text.mix((acc[b] - acc[a]) * down[a]).view(np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, pos) of every document."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            h, first = _hashed(data, offsets)
            n = np.diff(first)
            rows = [(i, *anchors(h[first[i] : first[i + 1]])) for i in np.flatnonzero(n >= WIDTH).tolist()]
            if rows:
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)), pa.array(np.repeat(ids[[r[0] for r in rows]], [len(r[1]) for r in rows])), pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32))],
                    names=["anchor", "doc_id", "pos"])

    return docs.mapInArrow(run, "anchor long, doc_id long, pos int")


def pieces(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, begin, words, mark) of the shared stretches of rows (doc_id, text, shared: array of first windows)."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            h, first = _hashed(data, offsets)
            short = (h >> np.uint64(32)).astype(np.uint32)
            key, who, begin, blob, end = [], [], [], [], []
            for i, (doc, shared) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                a, b = int(first[i]), int(first[i + 1])
                at, size, g = anchors(h[a:b])
                mine = np.isin(at, np.array(shared, dtype=np.int64))
                low, high = at[mine], (at + size)[mine] + WIDTH - 1
                key += g[mine].view(np.int64).tolist()
                who += [doc] * len(low)
                begin += low.tolist()
                blob += [short[a + x : a + y].tobytes() for x, y in zip(low.tolist(), high.tolist())]
                end += [np.column_stack([a + low, a + high])]
            if key:
                marks = span_marks(short, *np.concatenate(end).T)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(who, pa.int64()), pa.array(begin, pa.int32()), pa.array(blob, pa.binary()), pa.array(marks)], names=["anchor", "doc_id", "begin", "words", "mark"])

    return docs.mapInArrow(run, "anchor long, doc_id long, begin int, words binary, mark long")


class _Shard:
    """Distinct pieces of whole anchors and the documents that hold each."""

    def __init__(self):
        self.ids: dict[tuple[int, bytes], int] = {}
        self.docs: list[list[int]] = []
        self.begins: list[list[int]] = []
        self.words = 0

    def add(self, anchor: int, doc: int, begins: list[int], words: bytes) -> None:
        i = self.ids.setdefault((anchor, words), len(self.docs))
        if i == len(self.docs):
            self.docs.append([])
            self.begins.append([])
            self.words += len(words) // 4
        self.docs[i] += [doc] * len(begins)
        self.begins[i] += begins

    def removed(self):
        """A batch (doc_id, begins, ends, marks) of removed word ranges."""
        texts = [np.frombuffer(w, np.uint32) for _, w in self.ids]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        short = np.concatenate(texts)
        flat = np.unique(short, return_inverse=True)[1] + 1
        # documents in order; a piece counts from its least document on
        order = np.unique(np.concatenate([np.array(d, np.int64) for d in self.docs]))
        least = np.searchsorted(order, np.array([min(d) for d in self.docs]))
        index = FMIndex(flat, lengths, least, WIDTH * 2)
        # the first document of each piece, and one stream for all later ones
        more = np.array([len(set(d)) > 1 for d in self.docs])
        stream = np.concatenate([np.arange(len(texts)), np.flatnonzero(more)])
        limit = np.concatenate([least, least[more] + 1])
        start = np.cumsum(lengths) - lengths
        text = flat[_text.ranges(start[stream], lengths[stream])]
        who, a, b = earlier_windows(index, text, lengths[stream], limit, WIDTH)
        doc, x, y, m = [], [], [], []
        marks = span_marks(short, start[stream[who]] + a, start[stream[who]] + b)
        for s, p, q, mark in zip(who.tolist(), a.tolist(), b.tolist(), marks.tolist()):
            i = int(stream[s])
            first = order[least[i]]
            for d, at in zip(self.docs[i], self.begins[i]):
                if (d == first) == (s < len(texts)):
                    doc.append(d)
                    x.append(at + p)
                    y.append(at + q)
                    m.append(mark)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(m, pa.int64())], names=["doc_id", "a", "b", "mark"])


def _search(batches, most: int):
    """Pieces sorted by anchor to removed ranges, shard by shard."""
    shard, last = _Shard(), None
    for batch in batches:
        for anchor, doc, begins, words in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != last and shard.words >= most:
                yield shard.removed()
                shard = _Shard()
            last = anchor
            shard.add(anchor, doc, begins, words)
    if shard.docs:
        yield shard.removed()


CUTS = "doc_id long, a int, b int, mark long"


def _around(rows: DataFrame, shared: DataFrame, column: str) -> DataFrame:
    """The pieces of `rows` at the windows that `column` of `shared` lists."""
    chosen = shared.filter(F.size(column) > 0).select("doc_id", F.col(column).alias("shared"))
    return pieces(_bitmap.likely(rows, chosen).join(chosen, "doc_id").select("doc_id", "text", "shared"))


def _windows(batches, rows: int = 1000):
    """Rows (doc_id, begins, words) to a row for each of their windows, named by 128 bits."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            doc, begins, words = whole.slice(at, rows).columns
            n = np.array([len(w) // 4 for w in words.to_pylist()], dtype=np.int64)
            flat = np.frombuffer(b"".join(words.to_pylist()), np.uint32).astype(np.uint64)
            windows = n - WIDTH + 1
            own = np.repeat(np.arange(len(n)), windows)
            inside = _text.ranges(np.zeros(len(n), np.int64), windows)
            start = (np.cumsum(n) - n)[own] + inside
            keys = [_text.run_hashes(_text.mix(flat + np.uint64(salt)), WIDTH)[start].view(np.int64) for salt in (3, 5)] + [span_marks(flat, start, start + WIDTH)]
            size = np.diff(begins.offsets.to_numpy())
            first = np.cumsum(size) - size
            places = begins.flatten().to_numpy()[_text.ranges(first[own], size[own])] + np.repeat(inside, size[own])
            bounds = np.concatenate([[0], np.cumsum(size[own])])
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), doc.take(pa.array(own)), _text.ragged(places.astype(np.int32), bounds, pa.int32())], names=["key", "check", "mark", "doc_id", "begins"])


def _hot_cuts(around: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Removed ranges at very frequent anchors, and the tables that they are read from."""
    around = _spark.materialise(around, "hot-pieces")
    own = around.groupBy("anchor", "words", "doc_id").agg(F.collect_set("begin").alias("begins"), F.count("*").alias("n"))
    distinct = _spark.materialise(own.groupBy("anchor", "words").agg(F.min(F.struct("doc_id", "begins")).alias("first"), F.sum("n").alias("n")), "hot-distinct")
    least = distinct.filter("n > 1").select("anchor", "words", F.col("first.doc_id").alias("least"), "n")
    later = _spark.skew_join(around, least, ["anchor", "words"], heavy=hot).filter(F.col("doc_id") > F.col("least"))
    whole = later.select("doc_id", F.col("begin").alias("a"), (F.col("begin") + F.length("words") / 4).cast("int").alias("b"), "mark")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n")).withColumn("many", F.col("n") > hot)
    rows = _spark.skew_join(distinct.select("anchor", "first.doc_id", "first.begins", "words"), sizes, ["anchor"], heavy=hot)
    cuts = whole.unionByName(_shards(rows.filter("not many").drop("many")))
    single = _spark.materialise(rows.filter("many").select("doc_id", "begins", "words").mapInArrow(_windows, "key long, check long, mark long, doc_id long, begins array<int>"), "hot-windows")
    first = single.groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("least < last").drop("last")
    again = _spark.skew_join(single, first, ["key", "check"], heavy=hot).filter(F.col("doc_id") > F.col("least")).select("doc_id", F.explode("begins").alias("a"), "mark")
    return cuts.unionByName(again.select("doc_id", "a", (F.col("a") + WIDTH).cast("int").alias("b"), "mark")), [around, distinct, single]


def _shards(around: DataFrame) -> DataFrame:
    most = SHARD_WORDS
    return around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _search(it, most), CUTS)


def removed_ranges(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """(doc_id, ranges: array of (a, b, mark) word ranges to remove where the words have that mark) of the documents that lose words."""
    hot = hot or HOT
    rows = docs.filter("doc_id is not null")
    found = _spark.materialise(anchor_rows(rows), "anchors")
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).filter("x < y").select("anchor", "n", (F.col("n") > hot).alias("hot"))
    several = _spark.materialise(several, "shared-anchors")
    at = lambda cond: F.collect_list(F.when(cond, F.col("pos")))
    shared = _spark.skew_join(found, several, ["anchor"], heavy=hot).groupBy("doc_id").agg(at(~F.col("hot")).alias("cold"), at(F.col("hot")).alias("hot"))
    shared = _spark.materialise(shared, "shared")
    cuts = _shards(_around(rows, shared, "cold").select("anchor", "doc_id", F.array("begin").alias("begins"), "words"))
    used = [found, several, shared]
    if several.filter("hot").limit(1).count():
        more, tables = _hot_cuts(_around(rows, shared, "hot"), hot)
        cuts, used = cuts.unionByName(more), used + tables
    out = _spark.materialise(cuts.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "mark")).alias("ranges")), "removed")
    _spark.discard(*used)
    return out


def kept_texts(docs: DataFrame, ranges: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of all documents."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            raw, cut = data.tobytes(), offsets.tolist()
            n, gone, sha, text = [], [], [], []
            spans, size = part.column(2).flatten(), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
            if len(spans):
                h, first = _hashed(data, offsets)
                x, y, mark = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in spans.flatten())
                base, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
                inside = base + y <= end
                x, y, mark, base = x[inside], y[inside], mark[inside], base[inside]
                mine = span_marks((h >> np.uint64(32)).astype(np.uint32), base + x, base + y) == mark
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(edge, (base + x)[mine], 1)
                np.add.at(edge, (base + y)[mine], -1)
                keep = np.cumsum(edge)[:-1] == 0
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                w = raw[a:b].split()
                n.append(len(w))
                if size[i]:
                    w = [w[k] for k in np.flatnonzero(keep[first[i] : first[i + 1]]).tolist()]
                kept = b" ".join(w)
                gone.append(n[-1] - len(w))
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept)
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([t.decode() for t in text], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    some, rest = _bitmap.split(docs, ranges)
    rows = some.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    rows = rows.unionByName(rest.select("doc_id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove every word of a window of `WIDTH` words that also starts in a document with a smaller doc_id."""
    rows = _spark.texts(docs)
    return kept_texts(rows, removed_ranges(rows), with_text)
