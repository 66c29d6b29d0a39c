"""SentencePiece encoding and decoding by suffix-array matching.

A merge model's pieces are found in a batch at once: the distinct chunks of its texts (a run of spaces and what
follows) are concatenated, their suffixes sorted, and every piece binary-searched for its range of
occurrences.  The occurrences are edges, sorted by their end and relaxed from left to right: the encoding
of a prefix ends in exactly one piece, the one whose edge starts at a prefix whose own last piece stays
apart from it when the two are merged alone.  (An encoding is valid exactly if all its neighbours
are, since merges inside two neighbours happen in the same order alone as in the text.)

Verdicts on neighbours are found by merging both pieces' characters, best score first and leftmost among equal
ones, and kept in a bounded cache; so are chunks.  Characters without a piece become byte pieces.

Cases: a null or empty text has no piece and decodes to an empty text; U+2581 is a space; bytes that aren't
UTF-8 decode to U+FFFD; repeated rows are encoded each; extra columns are ignored; an empty table gives
an empty result; very long chunks are relaxed like others.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark, _text

SPACE = "▁"
CACHE_CHUNKS = 1_000_000
CACHE_PAIRS = 1_500_000
BATCH_CHARS = 150_000  # of new chunks that are matched at once


def _fields(raw: bytes) -> dict[int, object]:
    """The last value of each field of a protocol buffer message."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte, at = raw[at], at + 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            out[tag >> 3] = number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        out[tag >> 3] = raw[at : at + size]
        at += size
    return out


def check_model(raw: bytes) -> None:
    """Raise ValueError unless the file is a merge model with byte pieces that leaves texts as they are but for a space in front."""
    model = _fields(raw)
    trainer, normaliser = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    # fields of the published model format; absent ones have its defaults
    found = {
        "merge model": trainer.get(3, 1) == 2, "byte fallback": trainer.get(35, 0) == 1, "space before the piece": trainer.get(24, 0) == 0,
        "no character map": not normaliser.get(2, b""), "space put in front": normaliser.get(3, 1) == 1, "spaces kept": normaliser.get(4, 1) == 0, "spaces escaped": normaliser.get(5, 1) == 1}
    if missing := [k for k, ok in found.items() if not ok]:
        raise ValueError(f"not a model that this operator encodes: {', '.join(missing)}")


class Pieces:
    """The pieces of a merge model and what follows from them."""

    def __init__(self, names: list[str], scores: list[float], plain: list[bool], byte_ids: list[int]):
        self.names, self.size = names, len(names)
        ids = [i for i, ok in enumerate(plain) if ok]
        self.id_of = {names[i]: i for i in ids}
        self.width = max(len(names[i]) for i in ids)
        self.byte_ids = np.array(byte_ids, dtype=np.int64)
        _, self.rank = np.unique(-np.array(scores), return_inverse=True)  # equal scores rank equally
        self.length = np.ones(self.size + 1, dtype=np.int64)
        rows = np.zeros((len(ids), self.width), dtype=np.int32)
        for r, i in enumerate(ids):
            self.length[i] = len(names[i])
            rows[r, : len(names[i])] = [ord(c) + 1 for c in names[i]]
        self.ids, self.rows = np.array(ids, dtype=np.int64), rows
        # (left, right) -> piece, over all ways to cut a piece in two pieces
        joins = [(self.id_of[n[:k]] * (self.size + 1) + self.id_of[n[k:]], i) for i in ids for n in [names[i]] for k in range(1, len(n)) if n[:k] in self.id_of and n[k:] in self.id_of]
        joins.sort()
        self.join_keys, self.join_ids = np.array([k for k, _ in joins], dtype=np.int64), np.array([i for _, i in joins], dtype=np.int64)
        chars = [[self.id_of.get(c, self.size) for c in names[i]] for i in ids]
        self.char_flat = np.array(list(chain.from_iterable(chars)), dtype=np.int64)
        ptr = np.zeros(self.size + 2, dtype=np.int64)
        ptr[np.array(ids) + 1] = [len(c) for c in chars]
        self.char_ptr = np.cumsum(ptr)
        self.char_ptr[-1] = self.char_ptr[-2]
        whole = self.merged(self.char_flat, self.length[self.ids])
        self.stable = np.zeros(self.size + 1, dtype=bool)  # pieces that their own characters merge into
        self.stable[self.ids] = whole == 1
        self.stable[self.size] = True  # a character without a piece
        text = [n.replace(SPACE, " ").encode() for n in names]
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        self.text = text

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """Reads the vocabulary file; the library does no more than parse it.  Other kinds of models raise ValueError."""
        import sentencepiece

        with open(path, "rb") as f:
            check_model(f.read())
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        for i in range(n):
            if m.is_control(i) or m.is_unknown(i):
                names[i] = f"\0{i}"
        return cls(names, [m.get_score(i) for i in range(n)], [not s for s in special], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def merged(self, sym: np.ndarray, lengths: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
        """Symbols that are left of each sequence after all merges; with `cut`, 1 where a merge crosses that place, else 0."""
        out = np.zeros(len(lengths), dtype=np.int64)
        owner = np.arange(len(lengths))
        ends = np.cumsum(lengths)
        seq = np.repeat(owner, lengths)
        place = np.arange(len(sym)) - np.repeat(ends - lengths, lengths)
        out[:] = 1 if cut is None else 0
        while len(sym) > 1:
            key = sym[:-1] * (self.size + 1) + sym[1:]
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            ok = (self.join_keys[at] == key) & (seq[1:] == seq[:-1])
            pos = np.flatnonzero(ok)
            if cut is None:
                rest = np.bincount(seq, minlength=len(lengths))
                out[owner] = rest[owner]
            if not len(pos):
                break
            piece = self.join_ids[at[pos]]
            order = np.lexsort((pos, self.rank[piece], seq[pos]))
            first = np.concatenate([[True], seq[pos[order[1:]]] != seq[pos[order[:-1]]]])
            best = order[first]
            pos, piece = pos[best], piece[best]
            if cut is not None:
                crossed = place[pos + 1] == cut[seq[pos]]
                out[seq[pos[crossed]]] = 1
            sym = sym.copy()
            sym[pos] = piece
            keep = np.ones(len(sym), dtype=bool)
            keep[pos + 1] = False
            if cut is not None:  # a verdict ends the sequence, and so does having nothing to merge
                live = np.zeros(len(lengths), dtype=bool)
                live[seq[pos]] = True
                keep &= live[seq] & (out[seq] == 0)
            sym, seq, place = sym[keep], seq[keep], place[keep]
        if cut is None:
            rest = np.bincount(seq, minlength=len(lengths))
            out = rest
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two stable neighbours stay apart: no merge of their characters crosses from one to the other."""
        a, b = self.length[left], self.length[right]
        both = np.empty(int((a + b).sum()), dtype=np.int64)
        start = np.cumsum(a + b) - (a + b)
        both[_text.ranges(start, a)] = self._chars(left, a)
        both[_text.ranges(start + a, b)] = self._chars(right, b)
        return self.merged(both, a + b, a) == 0

    def _chars(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        flat = np.append(self.char_flat, self.size)
        begin = np.where(ids == self.size, len(self.char_flat), self.char_ptr[ids])
        return flat[_text.ranges(begin, lengths)]


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols."""
    n = len(text)
    rank = text.astype(np.int64)
    reach = 1
    order = np.argsort(rank, kind="stable")
    while True:
        by = rank[order]
        dense = np.concatenate([[1], 1 + np.cumsum(by[1:] != by[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = dense
        if reach >= depth or dense[-1] == n:
            return order
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:-reach] = rank[reach:]
        rank = rank * (n + 2) + nxt
        order = np.argsort(rank)
        reach *= 2


def occurrences(text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order of text and each row's range in it (rows: symbols, padded with 0)."""
    order = suffixes(text, rows.shape[1])
    padded = np.concatenate([text, np.zeros(rows.shape[1], dtype=text.dtype)])

    def bound(rows: np.ndarray, low: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), np.full(len(rows), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            less = np.zeros(len(open_), dtype=bool)
            tied = np.arange(len(open_))
            for k in range(rows.shape[1]):
                want = rows[open_[tied], k]
                here = padded[at[tied] + k]
                done = want == 0
                less[tied[~done & (here < want)]] = True
                if after:
                    less[tied[done]] = True
                tied = tied[~done & (here == want)]
                if not len(tied):
                    break
            if after and len(tied):
                less[tied] = True
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    low = bound(rows, np.zeros(len(rows), np.int64), False)
    high = low.copy()
    some = np.flatnonzero(low < len(order))
    for k in range(rows.shape[1]):  # rows that don't occur need no second search
        some = some[(rows[some, k] == 0) | (padded[order[low[some]] + k] == rows[some, k])]
    high[some] = bound(rows[some], low[some], True)
    return order, low, high


class Encoder:
    """Chunks to piece ids, with the caches of one worker."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._empty()
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.p.size + 1) + right
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == key
            ok = self.pair_ok[at] & known
        else:
            known, ok = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            verdict = self.p.apart(new // (self.p.size + 1), new % (self.p.size + 1))
            ok[~known] = verdict[np.searchsorted(new, key[~known])]
            if len(self.pair_keys) > CACHE_PAIRS:
                self.pair_keys, self.pair_ok = new, verdict
            else:
                where = np.searchsorted(self.pair_keys, new)
                self.pair_keys, self.pair_ok = np.insert(self.pair_keys, where, new), np.insert(self.pair_ok, where, verdict)
        return ok

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of the encodings of non-empty chunks."""
        p = self.p
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(size + 1) - size  # a separator before each chunk
        n = int(size.sum()) + len(chunks) + 1
        text = np.zeros(n, dtype=np.int32)
        text[_text.ranges(begin, size)] = np.frombuffer("".join(chunks).encode("utf-32-le"), np.int32) + 1
        letters = np.zeros(0x110002, dtype=bool)
        letters[text] = True
        possible = np.flatnonzero(letters[p.rows].all(axis=1))  # padding is the separator, which is there
        order, low, high = occurrences(text, p.rows[possible])
        count = high - low
        start = order[_text.ranges(low, count)]
        piece = np.repeat(p.ids[possible], count)
        alone = text > 0
        alone[start[p.length[piece] == 1]] = False
        lone = np.flatnonzero(alone)
        start, piece = np.concatenate([start, lone]), np.concatenate([piece, np.full(len(lone), p.size)])
        good = p.stable[piece]
        start, piece = start[good], piece[good]
        end = start + p.length[piece]
        first = np.zeros(n + 1, dtype=np.int64)
        first[_text.ranges(begin, size + 1)] = np.repeat(begin, size + 1)
        depth = end - first[end - 1]
        # edges by their end's place in the chunk, so that all chunks advance together
        by = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
        start, piece, end, depth = start[by], piece[by], end[by], depth[by]
        cut = np.concatenate([[0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]])
        last = np.full(n + 1, -1, dtype=np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            s, t, e = start[a:b], piece[a:b], end[a:b]
            before = last[s]
            ok = s == first[e - 1]
            inner = np.flatnonzero(~ok & (before >= 0))
            if len(inner):
                ok[inner] = self._apart(before[inner], t[inner])
            last[e[ok]] = t[ok]
        # walk back from each chunk's end
        at = begin + size
        mark = np.zeros(n + 1, dtype=bool)
        while len(at):
            if (last[at] < 0).any():
                raise RuntimeError("a prefix without an encoding")
            mark[at] = True
            at = at - p.length[last[at]]
            at = at[first[np.maximum(at, 0)] != at]
        ends = np.flatnonzero(mark)
        ids = last[ends]
        owner = np.searchsorted(begin, ends - 1, side="right") - 1
        unknown = np.flatnonzero(ids == p.size)
        if len(unknown):
            spelled = [chr(c - 1).encode("utf-8", "surrogatepass") for c in text[ends[unknown] - 1].tolist()]
            width = np.ones(len(ids), dtype=np.int64)
            width[unknown] = [len(s) for s in spelled]
            place = np.cumsum(width) - width
            ids, owner = np.repeat(ids, width), np.repeat(owner, width)
            ids[_text.ranges(place[unknown], width[unknown])] = p.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(chunks) + 1))

    def _empty(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their chunks
        self.flat, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)  # ids of the chunks
        self.raw, self.raw_ptr = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # their bytes
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks that were met more than twice, or none if these are too many."""
        keep = self.hits > 2
        if keep.sum() > CACHE_CHUNKS // 2:
            return self._empty()
        at, place = np.flatnonzero(keep), np.cumsum(keep) - 1
        for flat, ptr in (("flat", "ptr"), ("raw", "raw_ptr")):
            old = getattr(self, ptr)
            size = np.diff(old)[at]
            setattr(self, flat, getattr(self, flat)[_text.ranges(old[at], size)])
            setattr(self, ptr, np.concatenate([[0], np.cumsum(size)]))
        still = keep[self.codes]
        self.keys, self.codes = self.keys[still], place[self.codes[still]]
        self.hits = np.zeros(len(at), np.int64)

    def _find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The chunk of each distinct hash, -1 where it is new or its bytes are others."""
        if not len(self.keys):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        code = np.where(self.keys[at] == h, self.codes[at], -1)
        some = np.flatnonzero(code >= 0)
        same = (self.raw_ptr[code[some] + 1] - self.raw_ptr[code[some]]) == size[some]
        code[some[~same]] = -1
        some = some[same]
        if len(some):
            n = size[some]
            other = data[_text.ranges(start[some], n)] != self.raw[_text.ranges(self.raw_ptr[code[some]], n)]
            code[some[np.logical_or.reduceat(other, np.cumsum(n) - n)]] = -1
        return code

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encode new chunks; a hash that is taken keeps its first chunk."""
        whole = data.tobytes()
        new = [whole[a : a + n].decode("utf-8", "surrogatepass").replace(" ", SPACE) for a, n in zip(start.tolist(), size.tolist())]
        reach = np.cumsum([len(c) + 1 for c in new])
        cut = np.searchsorted(reach, np.arange(BATCH_CHARS, reach[-1] + BATCH_CHARS, BATCH_CHARS), side="right").tolist()
        done = [self.encode_chunks(new[a:b]) for a, b in zip([0, *cut], [*cut, len(new)]) if a < b]
        ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in done])])
        first = len(self.hits)
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in done)])
        self.ptr = np.concatenate([self.ptr, *(self.ptr[-1] + e + bounds[1:] for e, (_, bounds) in zip(ends, done))])
        self.raw = np.concatenate([self.raw, data[_text.ranges(start, size)]])
        self.raw_ptr = np.concatenate([self.raw_ptr, self.raw_ptr[-1] + np.cumsum(size)])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        code = np.arange(first, first + len(new))
        where = np.searchsorted(self.keys, h)
        free = (self.keys[np.minimum(where, len(self.keys) - 1)] != h) if len(self.keys) else np.ones(len(h), bool)
        self.keys, self.codes = np.insert(self.keys, where[free], h[free]), np.insert(self.codes, where[free], code[free])
        return code

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of a slice and their bounds.

        Equal chunks of a slice are recognised by a 64-bit hash, and cached ones by their bytes as well."""
        mark = SPACE.encode()
        if mark in (raw := data.tobytes()):
            parts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        if len(self.hits) > CACHE_CHUNKS:
            self._forget()
        text, start, end, bounds = chunks_of(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h, at, back, count = np.unique(_text.word_hashes(text, start, end), return_index=True, return_inverse=True, return_counts=True)
        begin, size = start[at], (end - start)[at]
        code = self._find(h, text, begin, size)
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = self._learn(h[new], text, begin[new], size[new])
        self.hits[code] += count
        each = code[back]
        n = (self.ptr[1:] - self.ptr[:-1])[each]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[_text.ranges(self.ptr[each], n)], total[bounds]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their bounds."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with a space put before each text that isn't empty, starts and ends of all chunks, and each text's first chunk.

    A chunk is a run of spaces and what follows up to the next space."""
    width = np.diff(offsets)
    full = width > 0
    shift = np.cumsum(full)
    text = np.full(len(data) + int(full.sum()), 0x20, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(shift, width)] = data
    heads = offsets[:-1] + shift - full
    space = text == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[heads[full]] = True
    start = np.flatnonzero(first)
    return text, start, np.append(start[1:], len(text)), np.searchsorted(start, np.append(heads, len(text)))


def decode_ids(text: list[bytes], ids: list[int]) -> str:
    """The text of a piece sequence, without the space put before the first piece."""
    raw = b"".join(map(text.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decoded_bytes(pieces: Pieces, flat: np.ndarray, bounds: np.ndarray) -> tuple[bytes, list[int]]:
    """The bytes of all piece sequences, one after the other, and where each begins."""
    size = np.fromiter(map(len, pieces.text), np.int64, len(pieces.text))
    at = np.cumsum(size) - size
    table = np.frombuffer(b"".join(pieces.text), np.uint8)
    out = table[_text.ranges(at[flat], size[flat])].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[flat])])
    return out, ends[bounds].tolist()


_STATE: dict[str, Encoder] = {}


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and round_trip (whether the ids decode to the text) of every row.

    The vocabulary (a fixed file of about 0.5 MB) is read once on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches):
        if model_path not in _STATE:
            _STATE[model_path] = Encoder(shared.value)
        enc = _STATE[model_path]
        for part, data, offsets in _text.slices(batches):
            flat, bounds = enc.encode_bytes(data, offsets)
            back, at = decoded_bytes(enc.p, flat, bounds)
            raw, cut = data.tobytes(), offsets.tolist()
            mark = SPACE.encode()
            same = [back[min(a + 1, b) : b] == raw[c:d].replace(mark, b" ") for a, b, c, d in zip(at, at[1:], cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), _text.ragged(flat, bounds, pa.int32()), pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return _spark.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_texts(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path).text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(shared.value, ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    _spark.ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
