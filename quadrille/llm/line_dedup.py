"""Near-duplicate lines by a segment-partition edit join.

A line of n characters is cut into t + 1 even segments, t being its edit threshold; within t edits at
least one segment survives whole in the other line, at a place that the two lengths restrict.  Lines are
indexed under their segments and probe with those of their substrings that the multi-match-aware rule
allows, for every indexable length not above their own.  Lines that meet under a key are verified with a
banded bit-parallel edit distance after common ends are cut off.

The threshold follows the shorter line: `edits` (2 unless said otherwise) from 20 characters, 1 from 10, none below.  Equal lines (after
trimming white space) are one class before the join, named by a 128-bit hash.  Links join lines into
components; the first line of a component (least doc_id, then line number) stays.  A line that very many documents
share sends its keys once a task, and its places are dealt over several tasks.

Keys are dealt and sorted, not paired: a key's members give only the links that their union still needs,
groups with the same members are verified once, and keys of more than `BLOCK` members are split into
pairs of blocks, each pair verified in a task of its own.  A key of over `HELD` rows is passed on as it
streams by and counted afterwards.

Cases: null texts have no line; blank lines are never duplicates; a row is its doc_id and text: rows that repeat both
are judged alike, and rows with other texts under one doc_id each by their own lines (of two near lines with one doc_id and
number, the one with the lesser name stays); rows with a null doc_id are counted, but nothing is removed from them and
they are no originals; very long lines are joined like others; extra columns, whatever their names, are ignored by the report and
carried by `without_duplicate_lines`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _bitmap, _spark, _text
from quadrille.llm.components import connected_components

LONG, MIDDLE = 20, 10
BLOCK = 512
HELD = 200_000
HEAVY = 1000
REMEMBERED = 200_000


def threshold(n: int, edits: int = 2) -> int:
    """Edits allowed between two lines of which the shorter has n characters."""
    return edits if n >= LONG else min(edits, 1) if n >= MIDDLE else 0


def edit_distance_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`, by bit-parallel steps over the diagonals of a band.

    One word per number of edits e; its bit d says that a[:i + d - limit] is within e edits of b[:i]."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return len(a) + len(b) <= limit
    where: dict[str, int] = {}
    for j, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << j + limit
    band = (1 << 2 * limit + 1) - 1
    states = [sum(1 << limit + j for j in range(e + 1)) for e in range(limit + 1)]
    for i, ch in enumerate(b):
        match = where.get(ch, 0) >> i & band
        below_old = below_new = 0
        for e in range(limit + 1):
            old = states[e]
            new = old & match | below_old | below_old >> 1 | below_new << 1 & band | below_new
            below_old, below_new, states[e] = old, new, new
        if not states[limit]:
            return False
    return bool(states[limit] >> len(a) - len(b) + limit & 1)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, trimmed line) of the lines that aren't blank."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def line_id(line: str) -> bytes:
    """128 bits that name a line."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def short_ids(ids: list[bytes]) -> np.ndarray:
    """The first half of each name as a long: what is dealt around; whole names decide."""
    return np.frombuffer(b"".join(ids), np.int64)[::2].copy() if ids else np.zeros(0, np.int64)


def segment_places(n: np.ndarray, t: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the t + 1 even segments of lines of n characters; the last ones are the longer."""
    q, r = np.divmod(n, t + 1)
    out, at = [], np.zeros_like(n)
    for i in range(t + 1):
        size = q + (i >= t + 1 - r)
        out.append((at, size))
        at = at + size
    return out


def join_keys(lines: list[str], edits: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, probes): all index and probe keys of lines. A pair within its threshold shares a key, one side indexing."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    value = _text.mix(flat + np.uint64(1)) | np.uint64(1)
    n = len(flat)
    up, down = _text._BYTES.get(n + 1)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value * up[:n], out=acc[1:])
    base = np.cumsum(size) - size
    keys, owner, probe = [], [], []

    def emit(who, start, length, indexed, segment, probes):
        a = base[who] + start
        tag = (indexed.astype(np.uint64) << np.uint64(16)) | np.uint64(segment)
        keys.append(_text.mix((acc[a + length] - acc[a]) * down[a] + _text.mix(tag + np.uint64(11))))
        owner.append(who)
        probe.append(np.full(len(who), probes))

    for t, low, high in [(1, MIDDLE, LONG), (edits, LONG, 1 << 60)] if edits > 0 else []:
        who = np.flatnonzero((size >= low) & (size < high))
        for i, (start, length) in enumerate(segment_places(size[who], t)):
            emit(who, start, length, size[who], i, False)
        for delta in range(t + 1):
            who = np.flatnonzero((size - delta >= low) & (size - delta < high))
            for i, (start, length) in enumerate(segment_places(size[who] - delta, t)):
                left = np.maximum(start - i, start + delta - (t - i))
                right = np.minimum(start + i, start + delta + (t - i))
                left, right = np.maximum(left, 0), np.minimum(right, size[who] - length)
                for shift in range(2 * t + delta + 1):
                    ok = left + shift <= right
                    if not ok.any():
                        break
                    emit(who[ok], (left + shift)[ok], length[ok], (size[who] - delta)[ok], i, True)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys).view(np.int64), np.concatenate(owner), np.concatenate(probe)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, id) of all lines of (doc_id, text, mark) that aren't blank."""
    def run(batches):
        for part, _, _ in _text.slices(batches):
            n, no, ids = [], [], []
            for text in part.column(1).to_pylist():
                lines = lines_of(text)
                n.append(len(lines))
                no += [i for i, _ in lines]
                ids += [line_id(s) for _, s in lines]
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), pa.array(no, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "mark", "line_no", "id"])

    return docs.mapInArrow(run, "doc_id long, mark long, line_no int, id binary")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): the mark tells texts under one doc_id apart."""
    return _spark.texts(docs).withColumn("mark", F.xxhash64("text"))


def _fresh(batches):
    """Per slice, its distinct lines that the task hasn't met before (it forgets after `REMEMBERED` lines) and their names."""
    met: set[bytes] = set()
    for part, _, _ in _text.slices(batches):
        lines = list({s: None for text in part.column(1).to_pylist() for _, s in lines_of(text) if len(s) >= MIDDLE})
        ids = list(map(line_id, lines))
        new = [i for i, x in enumerate(ids) if x not in met]
        if len(met) > REMEMBERED:
            met.clear()
        met.update(ids)
        yield [lines[i] for i in new], [ids[i] for i in new]


def keyed_lines(docs: DataFrame, edits: int) -> DataFrame:
    """(key, h, probes): every key of every line; a task sends the keys of equal lines once."""
    def run(batches):
        for lines, ids in _fresh(batches):
            key, who, probe = join_keys(lines, edits)
            h = short_ids(ids)
            for a in range(0, len(key), 1 << 17):
                cut = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(h[who[cut]]), pa.array(probe[cut])], names=["key", "h", "probes"])

    return docs.mapInArrow(run, "key long, h long, probes boolean")


def _groups(batches, held: int):
    """Rows (key, h, probes) sorted by key to (grp, h): the members of every key that has an indexed and another probing line.

    The group's number depends on its members only, so that the same members under another key are found to be the same."""
    rest = None

    def work(key, h, probe):
        order = np.lexsort((h, key))
        key, h, probe = key[order], h[order], probe[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
        at = np.flatnonzero(new)
        key, h = key[at], h[at]
        probes = np.logical_or.reduceat(probe, at)
        indexes = np.logical_or.reduceat(~probe, at)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        useful = (size > 1) & np.logical_or.reduceat(probes, cut) & np.logical_or.reduceat(indexes, cut)
        if not useful.any():
            return None
        number = np.add.reduceat(_text.mix(h.view(np.uint64)), cut)
        number = _text.mix(number + size.astype(np.uint64))
        pick = np.repeat(useful, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)[pick].view(np.int64)), pa.array(h[pick]), pa.array(np.repeat(size, size)[pick])], names=["grp", "h", "size"])

    def stream(key, h):
        """Members of a key that is too frequent to be held; they are counted and rid of repeats afterwards."""
        return pa.RecordBatch.from_arrays([pa.array(_text.mix(np.full(1, key).view(np.uint64) ^ np.uint64(1)).view(np.int64).repeat(len(h := np.unique(h)))), pa.array(h), pa.array(np.full(len(h), -1, np.int64))], names=["grp", "h", "size"])

    frequent = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if len(cols[0]) and cols[0][0] == frequent:
            n = int(np.searchsorted(cols[0], frequent, side="right"))
            yield stream(frequent, cols[1][:n])
            cols = [c[n:] for c in cols]
        rest = cols
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last and (out := work(*(c[:last] for c in cols))) is not None:
            yield out
        rest = [c[last:] for c in cols]
        if len(rest[0]) > held:
            frequent = rest[0][0]
            yield stream(frequent, rest[1])
            rest = [c[:0] for c in rest]
    if rest is not None and len(rest[0]) and (out := work(*rest)) is not None:
        yield out


def _letters(lines: list[str]) -> np.ndarray:
    """How often each line has a character of each of 32 classes: an edit changes at most two of these counts by one."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _text.mix(flat.astype(np.uint64) + np.uint64(1)) >> np.uint64(59)
    own = np.repeat(np.arange(len(lines)), size)
    return np.bincount(own * 32 + kind.astype(np.int64), minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def links_of(lines: list[str], edits: int) -> list[tuple[int, int]]:
    """Index pairs within their threshold that join all lines which such pairs connect.

    All longer lines of a line are compared at once by length and letters; what that leaves is verified by edit distance."""
    order = sorted(range(len(lines)), key=lambda i: (len(lines[i]), lines[i]))
    lines = [lines[i] for i in order]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    root, letters = np.arange(len(lines)), _letters(lines)
    out = []
    for i, line in enumerate(lines):
        t = threshold(len(line), edits)
        last = int(np.searchsorted(size, size[i] + t, side="right"))
        if last <= i + 1:
            continue
        near = np.flatnonzero((root[i + 1 : last] != root[i]) & (np.abs(letters[i + 1 : last] - letters[i]).sum(axis=1) <= 2 * t)) + i + 1
        for j in near.tolist():
            if root[j] != root[i] and edit_distance_within(line, lines[j], t):
                out.append((order[i], order[j]))
                root[root == root[j]] = root[i]
    return out


def near_links(docs: DataFrame, edits: int = 2) -> DataFrame:
    """(a, b): links between names of distinct lines, enough to connect all lines within their thresholds."""
    keyed = keyed_lines(docs, edits)
    held = HELD
    groups = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _groups(it, held), "grp long, h long, size long")
    groups = groups_table = _spark.materialise(groups.dropDuplicates(["grp", "h"]), "line-groups")
    counted = groups.filter("size < 0").groupBy("grp").agg(F.count("*").alias("members"))
    groups = groups.join(counted, "grp", "left").select("grp", "h", F.coalesce("members", "size").alias("size"))
    # members of large groups go to every pair of blocks that holds theirs
    parts = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("h"), parts)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own)))
    dealt = groups.select("h", F.when(parts > 1, F.lit(True)).otherwise(False).alias("large"), "grp", pair.alias("pair")).select(F.when(F.col("large"), F.xxhash64("grp", "pair")).otherwise(F.col("grp")).alias("grp"), "h")
    wanted = groups.select("h").distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap.build(wanted))

    def texts(batches):
        for lines, ids in _fresh(batches):
            h = short_ids(ids)
            pick = np.flatnonzero(_bitmap.holds(bitmap.value, h))
            yield pa.RecordBatch.from_arrays([pa.array(h[pick]), pa.array([ids[i] for i in pick], pa.binary()), pa.array([lines[i] for i in pick], pa.string())], names=["h", "id", "line"])

    lines = docs.mapInArrow(texts, "h long, id binary, line string").join(wanted, "h", "left_semi").dropDuplicates(["h", "id"])

    def verify(batches):
        grp, rows = None, []

        def links():
            return [(rows[i][0], rows[j][0]) for i, j in links_of([r[1] for r in rows], edits)]

        for batch in batches:
            out = []
            for g, i, s in zip(*(c.to_pylist() for c in batch.columns)):
                if g != grp:
                    out += links()
                    grp, rows = g, []
                rows.append((i, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    found = dealt.join(lines, "h").select("grp", "id", "line").repartition("grp").sortWithinPartitions("grp").mapInArrow(verify, "a binary, b binary")
    found = _spark.materialise(found.distinct(), "line-links")
    _spark.discard(groups_table)
    bitmap.destroy()
    return found


def duplicate_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """(doc_id, mark, line_no, kept_doc, kept_line): each line that goes, with the first line of its component."""
    docs = marked(docs).filter("doc_id is not null")
    rows = _spark.materialise(line_rows(docs), "lines")
    classes = rows.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    links = near_links(docs.select("doc_id", "text"), edits)
    parts = connected_components(links)
    # a line that stands once and has no link stays: it isn't looked up again
    named = classes.join(parts, F.col("id") == F.col("node"), "left").filter("n > 1 or node is not null").select("id", "n", "first", F.coalesce("component", "id").alias("component"))
    named = _spark.materialise(named, "line-classes")
    heads = named.groupBy("component").agg(F.min(F.struct("first.doc_id", "first.line_no", "id")).alias("head"), F.count("*").alias("_size"))
    several = _spark.skew_join(named, heads, ["component"], n="_size", heavy=HEAVY).select("id", "head", "n")
    stays = F.struct("doc_id", "line_no", "id") == F.col("head")
    gone = _spark.skew_join(rows, several, ["id"], heavy=HEAVY).filter(~stays).select("doc_id", "mark", "line_no", F.col("head.doc_id").alias("kept_doc"), F.col("head.line_no").alias("kept_line"))
    out = _spark.materialise(gone, "lines-gone")
    _spark.discard(rows, links, named)
    return out


def line_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_lines) of every row."""
    def run(batches):
        for part, _, _ in _text.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(lines_of(t)) for t in part.column(1).to_pylist()], pa.int64())], names=["doc_id", "mark", "n_lines"])

    return marked(docs).mapInArrow(run, "doc_id long, mark long, n_lines long")


def line_report(docs: DataFrame, edits: int = 2) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, removed (line numbers, ascending) and kept_docs (doc_ids of the lines kept instead)."""
    gone = duplicate_lines(docs, edits).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("removed"), F.sort_array(F.collect_set("kept_doc")).alias("kept_docs"))
    return line_counts(docs).join(gone, ["doc_id", "mark"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("kept_docs", F.array().cast("array<long>")).alias("kept_docs"))


def without_duplicate_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """`docs` with the text of each row rid of its duplicate lines; other columns stay, but n_chars is counted anew if it is a whole number."""
    own = "_" + max(docs.columns, key=len)  # no column's name begins so
    mark, removed = f"{own}_mark", f"{own}_removed"
    gone = duplicate_lines(docs, edits).groupBy("doc_id", F.col("mark").alias(mark)).agg(F.collect_set("line_no").alias(removed))
    numbered = F.transform(F.split("text", "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda x: ~F.array_contains(removed, x["i"])), lambda x: x["s"]), "\n")
    out = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).join(gone, ["doc_id", mark], "left")
    out = out.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    kind = dict(docs.dtypes).get("n_chars")
    if kind in ("smallint", "int", "bigint"):
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)
