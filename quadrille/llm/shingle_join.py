"""Near copies by the Jaccard similarity of five-word shingles.

A text is the set of its shingles' 32-bit hashes.  Sets meet under the bands of a min-hash signature (25 bands of
5 rows: a pair of similarity 0.8 shares none with probability 5e-5, a pair of 0.9 practically never) and are
verified by the exact similarity of the two sets.  Bands only propose pairs; a pair below the limit is never linked.
Only band keys are stored for every text; the sets of texts that meet another are made again when they are compared.

Equal sets are one class before the join.  Bands with the same members are verified once; a band's members give
only the links that their union still needs; bands of more than `BLOCK` members are split into pairs of blocks,
each pair verified in a task of its own, so that no pair is left out.

Cases: texts without words are in no class; texts of null doc_ids only link nothing; a text of fewer than five words is one shingle; repeated doc_ids and
repeated shingles count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _bitmap, _spark, _text

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
BLOCK = 1024
HELD = 200_000
HEAVY = 1000
_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingle hashes, ascending; ASCII letters without case."""
    data = _text.lower_table()[data]
    starts, ends, first = _text.words(data, offsets, _text.space_table())
    h = _text.word_hashes(data, starts, ends)
    runs = _text.run_hashes(h, width)
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    flat, own = runs[_text.ranges(first[:-1], count)], np.repeat(np.arange(len(n)), count)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short = np.array([_text.run_hashes(h[first[i] : first[i + 1]], n[i])[0] for i in few], dtype=np.uint64)
        flat, own = np.concatenate([flat, short]), np.concatenate([own, few])
    both = np.unique(own.astype(np.uint64) << np.uint64(32) | flat >> np.uint64(32))
    return both.astype(np.uint32), np.searchsorted(both, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(32))


def band_keys(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of `BANDS` keys for each set; all sets must have members."""
    h = _text.mix(flat.astype(np.uint64) + np.uint64(1))
    out = np.zeros((len(bounds) - 1, BANDS), dtype=np.uint64)
    for i, odd in enumerate(_ODD):
        x = h * odd
        least = np.minimum.reduceat(x ^ x >> np.uint64(32), bounds[:-1])
        out[:, i // ROWS] = _text.mix(out[:, i // ROWS] ^ least)
    return _text.mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))


def sketches(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, s, keys): a hash of each text's set and its band keys; given `among`, the set itself (bytes of uint32, named members)
    instead of the keys, of all documents whose doc_id is there and few others."""
    members = among is not None
    rows, chosen = _bitmap.sieve(_spark.texts(docs), among) if members else (_spark.texts(docs), iter)

    def run(batches):
        for part, data, offsets in _text.slices(chosen(batches)):
            flat, bounds = shingle_sets(data, offsets)
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            cut = np.append(bounds[some], bounds[-1])
            s = _text.mix(np.add.reduceat(_text.mix(flat.astype(np.uint64) + np.uint64(7)), cut[:-1]) + np.diff(cut).astype(np.uint64))
            if members:
                last = pa.array([flat[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            else:
                last = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(flat, cut).ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(s.view(np.int64)), last], names=["doc_id", "s", "members" if members else "keys"])

    return rows.mapInArrow(run, f"doc_id long, s long, {'members binary' if members else 'keys array<long>'}")


def _groups(batches, held: int):
    """Rows (key, s) sorted by key to (grp, s, size) of every key with several members; the number depends on the members only.

    A key of over `held` rows is passed on as it streams by, with size -1, and counted afterwards."""
    frequent = None
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def work(key, s):
        order = np.lexsort((s, key))
        key, s = key[order], s[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (s[1:] != s[:-1])])
        key, s = key[new], s[new]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        number = _text.mix(np.add.reduceat(_text.mix(s.view(np.uint64)), cut) + size.astype(np.uint64))
        pick = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)[pick].view(np.int64)), pa.array(s[pick]), pa.array(np.repeat(size, size)[pick])], names=["grp", "s", "size"])

    def stream(key, s):
        s = np.unique(s)
        number = _text.mix(np.full(1, key, dtype=np.int64).view(np.uint64) ^ np.uint64(1)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(number.repeat(len(s))), pa.array(s), pa.array(np.full(len(s), -1, np.int64))], names=["grp", "s", "size"])

    for batch in batches:
        rest = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
        if len(rest[0]) and rest[0][0] == frequent:
            n = int(np.searchsorted(rest[0], frequent, side="right"))
            yield stream(frequent, rest[1][:n])
            rest = [r[n:] for r in rest]
        if not len(rest[0]):
            continue
        last = int(np.searchsorted(rest[0], rest[0][-1]))
        if last:
            yield work(rest[0][:last], rest[1][:last])
        rest = [r[last:] for r in rest]
        if len(rest[0]) > held:
            frequent = rest[0][0]
            yield stream(frequent, rest[1])
            rest = [r[:0] for r in rest]
    if len(rest[0]):
        yield work(*rest)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two ascending sets is at least `least`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def links_of(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Index pairs of similar sets, enough of them to connect all that such pairs connect."""
    root = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out = []
    for i in range(len(sets) - 1):
        for j in np.flatnonzero((root != root[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]))):
            if j > i and root[j] != root[i] and similar(sets[i], sets[j], least):
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def near_links(classes: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between the sets s of classes(s, rep, keys), enough to connect all similar ones that meet; a set is that of its document rep in docs."""
    keyed = classes.select(F.explode("keys").alias("key"), "s")
    held = HELD
    groups = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _groups(it, held), "grp long, s long, size long")
    stored = _spark.materialise(groups.dropDuplicates(["grp", "s"]), "shingle-groups")
    counted = stored.filter("size < 0").groupBy("grp").agg(F.count("*").alias("members"))
    groups = stored.join(counted, "grp", "left").select("grp", "s", F.coalesce("members", "size").alias("size"))
    # members of large groups go to every pair of blocks that holds theirs
    parts = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("s"), parts)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own)))
    dealt = groups.select(F.col("grp"), "s", pair.alias("pair")).select(F.xxhash64("grp", "pair").alias("grp"), "s")
    reps = _spark.materialise(classes.join(stored.select("s").distinct(), "s", "left_semi").select(F.col("rep").alias("doc_id"), "s"), "shingle-reps")
    sets = sketches(docs, reps).join(reps, ["doc_id", "s"], "left_semi").select("s", "members").dropDuplicates(["s"])

    def verify(batches):
        grp, held = None, []

        def links():
            pairs = links_of([np.frombuffer(m, np.uint32) for _, m in held], least)
            return [(held[i][0], held[j][0]) for i, j in pairs]

        for batch in batches:
            out = []
            for g, s, m in zip(*(c.to_pylist() for c in batch.columns)):
                if g != grp:
                    out += links()
                    grp, held = g, []
                held.append((s, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    found = dealt.join(sets, "s").select("grp", "s", "members").repartition("grp").sortWithinPartitions("grp").mapInArrow(verify, "a long, b long")
    found = _spark.materialise(found.distinct(), "shingle-links")
    _spark.discard(stored, reps)
    return found


def similar_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between doc_ids whose shingle sets are equal or similar, each class standing for its least doc_id."""
    rows = _spark.materialise(sketches(docs).filter("doc_id is not null"), "shingles")
    classes = _spark.materialise(rows.groupBy("s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys")), "shingle-classes")
    found = near_links(classes, docs, least)
    stored, classes = classes, classes.drop("keys")
    of = lambda c, rep: classes.select(F.col("s").alias(c), F.col("rep").alias(rep))
    between = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = _spark.skew_join(rows.select("doc_id", "s"), classes.filter("n > 1"), ["s"], heavy=HEAVY).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    out = _spark.materialise(between.union(copies), "similar")
    _spark.discard(rows, stored, found)
    return out
