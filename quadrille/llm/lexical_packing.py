"""Packing by lexical retrieval: windows of related documents out of sharded BM25 indexes.

Documents are tokenized once, into a table of ids with a min-hash of each document.  Documents of near min-hashes go to the
same shard, and shards are dealt by exact sums of tokens: a min-hash cell that is larger than a shard (a group of
copies may hold a third of all rows) goes over as many shards as it fills, by a hash of the row.  A shard builds an inverted
index of its documents' ids with BM25 impacts.  The first unused document is the seed of a window; the documents that match its
heaviest terms best and aren't used yet fill the window greedily, and where they don't reach, the next seed does.  The last
one is cut where the window ends, and its rest is the next seed.  So all windows are full but those of a shard's end,
which is cut into sequences of powers of two: nothing is padded.

Every id of every document lies in one piece; a task holds one shard (about `SHARD_TOKENS` ids, or one longer document).

Cases: null and empty texts are the end id alone; repeated rows, and rows that share a doc_id, are packed each; rows of equal
min-hash are dealt alike whatever their number; ties of scores take the first in the shard's order (min-hash, doc_id, hash of
the row); a document longer than a window fills windows by itself and its rest is a seed; a null doc_id stays null;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark, _text
from quadrille.llm.token_ids import TokenIds, character_classes

WINDOW = 2048
SHARD_TOKENS = 4 << 20
CELLS = 1 << 16  # of min-hashes; their sums come to the driver and are broadcast
TERMS = 16  # the seed's terms that are asked for
K1, B = 1.2, 0.75
TOKENS = "doc_id long, mark long, sketch long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ENCODERS: dict[str, TokenIds] = {}


def sketches(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the least hash of two neighbouring ids, 0 for texts of one id."""
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    h = _text.mix((ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:])
    h = np.append(h, np.uint64((1 << 64) - 1))
    h[bounds[1:] - 1] = np.uint64((1 << 64) - 1)
    some = np.flatnonzero(np.diff(bounds) > 1)
    if len(some):
        least = np.minimum.reduceat(h, bounds[:-1])[some]
        out[some] = (_text.mix(least) >> np.uint64(1)).astype(np.int64)  # least values crowd: spread them
    return out


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, mark, sketch, n_tokens, ids) of every row; ids as little-endian 16-bit numbers, or 32-bit ones for larger vocabularies."""
    classes = docs.sparkSession.sparkContext.broadcast(character_classes())

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = TokenIds(path, classes.value)
        coder = _ENCODERS[path]
        kind = np.uint16 if max(coder.size, end_id + 1) <= 1 << 16 else np.uint32
        for part, data, offsets in _text.slices(batches):
            ids, first = coder.encode(data, offsets)
            n = np.diff(first) + 1
            bounds = np.concatenate([[0], np.cumsum(n)])
            flat = np.full(bounds[-1], end_id, dtype=kind)
            inside = np.ones(len(flat), dtype=bool)
            inside[bounds[1:] - 1] = False
            flat[inside] = ids
            blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sketches(flat, bounds)), pa.array(n), blob], names=[c.split()[0] for c in TOKENS.split(", ")])

    rows = _spark.texts(docs)
    return rows.withColumn("mark", F.xxhash64("doc_id", "text")).mapInArrow(run, TOKENS)


class Index:
    """BM25 postings of one shard: by term, the documents that hold it and their impacts."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        self.ids, self.bounds, self.n = ids, bounds, n
        length = np.diff(bounds)
        owner = np.repeat(np.arange(n), length)
        key, tf = np.unique(ids.astype(np.int64) * n + owner, return_counts=True)
        term, self.doc = np.divmod(key, n)
        self.doc = self.doc.astype(np.int32)
        self.first = np.searchsorted(term, np.arange(int(ids.max(initial=0)) + 2))
        df = np.diff(self.first)
        self.idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0)  # a term of one document finds no neighbour
        self.impact = (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / length.mean())[self.doc]))).astype(np.float32)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """The unused documents that hold one of the seed's heaviest terms, best first."""
        term, tf = np.unique(self.ids[self.bounds[seed] : self.bounds[seed + 1]], return_counts=True)
        weight = self.idf[term] * tf / (tf + K1)
        if len(term) > TERMS:
            top = np.argsort(-weight, kind="stable")[:TERMS]
            term, weight = term[top], weight[top]
        term = term[weight > 0]
        if not len(term):
            return term.astype(np.int64)
        at = _text.ranges(self.first[term], self.first[term + 1] - self.first[term])
        score = np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(ids: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """(document, start, length, sequence, offset) of the pieces of one shard, sequences from 0 on."""
    index = Index(ids, bounds)
    size = np.diff(bounds).tolist()
    used = np.zeros(index.n, dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, offset, unseen = 0, 0, 0
    seed, start = -1, 0

    def put(doc, start):
        """As much of a document as the window takes; where it ended."""
        nonlocal sequence, offset
        n = min(window - offset, size[doc] - start)
        pieces.append((doc, start, n, sequence, offset))
        offset += n
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + n

    while True:
        if seed < 0:
            while unseen < index.n and used[unseen]:
                unseen += 1
            if unseen == index.n:
                break
            seed, start = unseen, 0
            used[seed] = True
        while start < size[seed]:
            start = put(seed, start)
        following = -1
        if offset:
            for doc in index.neighbours(seed, used).tolist():
                used[doc] = True
                start = put(doc, 0)
                if not offset:
                    following = doc if start < size[doc] else -1
                    break
        seed = following
    out = np.array(pieces, dtype=np.int64).reshape(-1, 5)
    return _cut_tail(out, sequence, offset) if offset else out


def _cut_tail(pieces: np.ndarray, sequence: int, total: int) -> np.ndarray:
    """The unfinished last sequence as sequences of powers of two, longest first."""
    done, tail = pieces[pieces[:, 3] < sequence], pieces[pieces[:, 3] == sequence]
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    stops = np.cumsum(sizes)
    begin = tail[:, 4]
    cuts = np.unique(np.concatenate([begin, stops[:-1]]))
    of = np.searchsorted(begin, cuts, side="right") - 1
    length = np.diff(np.append(cuts, total))
    which = np.searchsorted(stops, cuts, side="right")
    new = np.column_stack([tail[of, 0], tail[of, 1] + cuts - begin[of], length, sequence + which, cuts - (stops - sizes)[which]])
    return np.concatenate([done, new])


def shards(tokens: DataFrame, shard_tokens: int) -> DataFrame:
    """The rows with their shard's number, each shard's rows together in one task in their fixed order."""
    cell = F.pmod("sketch", F.lit(CELLS)).cast("int")
    sums = sorted((r.cell, r.n) for r in tokens.groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("n")).collect())
    n = np.array([x for _, x in sums], dtype=np.int64)
    total = int(n.sum())
    parts = max(1, -(-total // shard_tokens))
    rows = [(c, int(b), int(m)) for (c, m), b in zip(sums, np.cumsum(n) - n)]
    places = tokens.sparkSession.createDataFrame(rows, "cell int, before long, size long")  # CELLS rows at most
    # a row's place among all tokens: its cell's, and in the cell by the row's hash
    place = F.col("before") + (F.col("size") * (F.pmod("mark", F.lit(1 << 20)) / (1 << 20))).cast("long")
    dealt = tokens.withColumn("cell", cell).join(F.broadcast(places), "cell").withColumn("part", F.least(F.floor(place * parts / total), F.lit(parts - 1)).cast("int"))
    return dealt.select("part", "doc_id", "mark", "sketch", "ids").repartitionById(parts, "part").sortWithinPartitions("part", "sketch", "doc_id", "mark")


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (little-endian, 32 bits each).

    `path` is a byte-level vocabulary; every document's ids are followed by `end_id`."""
    tokens = _spark.materialise(tokenized(docs, path, end_id), "token-ids", "zstd")
    wide = max(TokenIds(path, np.zeros(1)).size, end_id + 1) > 1 << 16

    def run(batches):
        held: list[tuple] = []
        state = [-1, 0, 0]  # shard's number, tokens held, sequences so far

        def close():
            flat = np.concatenate([np.frombuffer(b, np.uint32 if wide else np.uint16) for _, b in held])
            size = np.array([len(b) // (4 if wide else 2) for _, b in held], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            keys = pa.array([k for k, _ in held], pa.int64())
            pieces = pack(flat, bounds, window)
            base = (state[0] << 32) + state[2]
            state[2] += int(pieces[:, 3].max()) + 1
            state[1] = 0
            held.clear()
            for a in range(0, len(pieces), 1024):
                doc, start, length, sequence, offset = np.ascontiguousarray(pieces[a : a + 1024].T)
                ids = flat[_text.ranges(bounds[doc] + start, length)].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *map(pa.array, (start, length, size[doc], base + sequence, offset)), blob], names=[c.split()[0] for c in PIECES.split(", ")])

        _text.release()
        for batch in batches:
            for part, key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4))):
                if held and (part != state[0] or state[1] >= shard_tokens * 2):
                    yield from close()
                if part != state[0]:
                    state[0], state[2] = part, 0
                held.append((key, ids))
                state[1] += len(ids) // (4 if wide else 2)
        if held:
            yield from close()
        _text.release()

    return shards(tokens, shard_tokens).mapInArrow(run, PIECES)
