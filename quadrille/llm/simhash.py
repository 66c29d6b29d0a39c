"""SimHash near-duplicates by deletion-variant signatures.

Sixty-four-bit fingerprints that differ in at most k bits are cut into k // 2 + 1 segments, so that one
segment differs in at most one bit.  Each segment is indexed under all its one-wildcard variants
(one bit blanked); two fingerprints meet by equality of a variant and are then verified in full.

Equal fingerprints are one class before any link is sought.  Variants are dealt by their key and sorted;
neighbours under one key are compared as arrays.  A key shared by many fingerprints yields only the
links that a union of its own members still needs, so a hot key gives rows in proportion to its
members and no link is lost; a key over `BLOCK` members is split into pairs of blocks dealt to
different tasks.

Cases: null and empty texts have fingerprint zero and link like any other; a text of fewer words than a
shingle is one shingle; repeated shingles count; ties (exactly half) give bit 0; repeated doc_ids
count once; a very long text is a slice of its own and read whole; a row with a null doc_id has the
component of its fingerprint; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark, _text
from quadrille.llm.components import connected_components

BLOCK = 4096
HOT_SAMPLE = 64
HOT_BROADCAST = 100_000
HOT_CLASS = 1000
WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_rows(values: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: bit i is set if it is set in over half of the shingle hashes."""
    low = bytes(_text.lower_table())
    digest, find = xxhash.xxh64_intdigest, WORD.findall
    hashes, counts = [], []
    for raw in values:
        w = find(raw.translate(low))
        if len(w) <= width:
            row = [digest(b" ".join(w), seed)] if w else []
        else:
            row = [digest(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(width))))]
        counts.append(len(row))
        hashes.append(np.array(row, dtype=np.uint64))
    counts = np.array(counts, dtype=np.int64)
    out = np.zeros(len(values), dtype=np.uint64)
    for i in np.flatnonzero(counts):
        bits = np.unpackbits(hashes[i].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduce(bits, axis=0, dtype=np.int64)
        out[i] = int("".join(map(str, (2 * ones > counts[i]).astype(int).tolist())), 2)
    return out


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches):
        for part, data, offsets in _text.slices(batches):
            raw, cut = data.tobytes(), offsets.tolist()
            fp = fingerprint_rows([raw[a:b] for a, b in zip(cut, cut[1:])], width, seed)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return _spark.texts(docs).mapInArrow(run, "doc_id long, fp long")


def segments(k: int) -> list[tuple[int, int]]:
    """(shift, width) of k // 2 + 1 segments of nearly equal width."""
    n = k // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variant_keys(fp: np.ndarray, k: int) -> np.ndarray:
    """All one-wildcard variants: a row per fingerprint, a column per segment bit; distinct columns never collide."""
    cols = []
    for s, (shift, width) in enumerate(segments(k)):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        cols += [(value & ~np.uint64(1 << bit)) << np.uint64(13) | np.uint64(s << 7 | bit) for bit in range(width)]
    return np.stack(cols, axis=1)


def _links_of_group(fp: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Index pairs within k bits that join distinct parts; enough of them that every pair within k bits is connected."""
    parent = np.arange(len(fp))
    links = []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= k) + i + 1
        if not len(near):
            continue
        roots = np.unique(parent[near])
        roots = roots[roots != parent[i]]
        for r in roots:
            links.append((i, int(near[parent[near] == r][0])))
        if len(roots):
            parent[np.isin(parent, roots)] = parent[i]
    return links


def _linked(batches, k: int):
    """Rows (key, fp) sorted by key to links (a, b) of fingerprints; a group may span batches."""
    rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def work(key, fp):
        a, b = [], []
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        small = np.repeat((size > 1) & (size <= 16), size)
        sk, sf = key[small], fp[small]
        for d in range(1, 16):
            if len(sk) <= d:
                break
            same = np.flatnonzero(sk[d:] == sk[:-d])
            if not len(same):
                break
            hit = same[np.bitwise_count(sf[same] ^ sf[same + d]) <= k]
            a.append(sf[hit])
            b.append(sf[hit + d])
        for g in np.flatnonzero(size > 16):
            part = np.unique(fp[cut[g] : cut[g + 1]])
            if pairs := _links_of_group(part, k):
                x, y = np.array(pairs).T
                a.append(part[x])
                b.append(part[y])
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["fa", "fb"])

    for batch in batches:
        key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last and (out := work(key[:last], fp[:last])) is not None:
            yield out
        rest_key, rest_fp = key[last:], fp[last:]
    if len(rest_key) and (out := work(rest_key, rest_fp)) is not None:
        yield out


def near_links(fps: DataFrame, k: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (fa, fb) between distinct fingerprints of fps(fp) within k bits, enough to connect all that link."""
    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = variant_keys(fp, k)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    # a fingerprint makes 64 rows: deal them evenly before, whatever few partitions they have come in
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = fps.mapInArrow(index, "key long, fp long")
    hot = _spark.materialise(hot_keys(keyed, block), "simhash-hot")
    n_hot = hot.count()
    cold, split = keyed, None
    if n_hot:
        parts = F.col("parts")
        own = F.pmod(F.xxhash64("fp"), parts)
        other = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own)))
        dealt = keyed.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "key", "left")
        split = dealt.filter(parts.isNotNull()).select("key", "fp", other.alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "fp")
        cold = dealt.filter(parts.isNull()).select("key", "fp").union(split)
    return cold.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _linked(it, k), "fa long, fb long")


def hot_keys(keyed: DataFrame, block: int) -> DataFrame:
    """(key, parts) of keys with more than about `block` members, estimated on one fingerprint in `HOT_SAMPLE`.

    Which keys count as hot only decides how the work is dealt; the links are the same for any choice."""
    some = keyed.filter(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0)
    return some.groupBy("key").agg((F.count("*") * HOT_SAMPLE).alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("long").alias("parts"))


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of at most k bits).

    Components are found among distinct fingerprints; a fingerprint that very many documents share is dealt over several tasks."""
    rows = _spark.materialise(fingerprints(docs, width, seed), "simhash")
    classes = _spark.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    parts = connected_components(near_links(classes.select("fp"), k).select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "n", "rep", F.coalesce("component", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("_size"))
    named = _spark.materialise(_spark.skew_join(named, heads, ["root"], n="_size", heavy=HOT_CLASS).select("fp", "component_id", "n"), "simhash-named")
    _spark.discard(classes)
    return _spark.skew_join(rows, named, ["fp"], heavy=HOT_CLASS).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
