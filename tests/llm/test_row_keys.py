"""Rows that share a doc_id but not their text: each loses only what it has itself."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
from quadrille.llm import line_dedup, substring_dedup  # noqa: E402
from test_operators import find  # noqa: E402


def kept_words(rows, width=50):
    """Rows (doc_id, text) by the rule itself."""
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [None, 3])
def test_words_of_several_texts_under_one_id(spark, hot):
    rng = random.Random(8)
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(1, p), (5, p), (5, q), (5, p), (7, q + " " + p), (7, p + " end"), (None, p), (None, q), (6, None), (6, "")]
    passages = [" ".join(f"s{k}x{i}" for i in range(rng.randint(50, 90))) for k in range(5)]
    rows += [(rng.randint(10, 25), " ".join(rng.sample(passages, rng.randint(1, 3)) + [f"u{j}"])) for j in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, mark string, ranges int")
    texts = substring_dedup._spark.texts(docs)
    got = substring_dedup.kept_texts(texts, substring_dedup.removed_ranges(texts, hot)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == kept_words(rows)


def kept_lines(rows):
    """The texts that are left, by the rule itself: of each component the first line (doc_id, number, name) stays."""
    lines = {}
    for i, t in rows:
        for n, s in line_dedup.lines_of(t) if i is not None else ():
            lines.setdefault(s, set()).add((i, n))
    names = sorted(lines, key=len)
    parent = {x: x for x in names}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if line_dedup.threshold(len(a)) and line_dedup.edit_distance_within(a, b, line_dedup.threshold(len(a))):
                parent[find(parent, a)] = find(parent, b)
    heads = {}
    for s in names:
        for i, n in lines[s]:
            c = find(parent, s)
            heads[c] = min(heads.get(c, (i, n, line_dedup.line_id(s))), (i, n, line_dedup.line_id(s)))
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        gone = {n for n, s in line_dedup.lines_of(t) if heads[find(parent, s)] != (i, n, line_dedup.line_id(s))}
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)))
    return out


def test_lines_of_several_texts_under_one_id(spark):
    rng = random.Random(3)
    a, b = "a line that stands in many documents here", "another line that nobody else has at all"
    pool = [f"sentence number {k} of the pool of lines, {rng.random()}" for k in range(12)]
    rows = [(1, a), (5, a), (5, b), (5, a + "!"), (4, b + "?\n" + a), (None, a), (None, b), (3, None), (3, ""), (9, a), (9, a), (8, b + "\n\n" + b)]
    rows += [(rng.randint(20, 30), "\n".join(rng.choice(pool) + rng.choice(["", "", "x"]) for _ in range(3))) for _ in range(40)]
    rows += [(2, "the very same place one"), (2, "the very same place two"), (2, "the very same place on")]
    docs = spark.createDataFrame([(i, t, "keep", f"n{k}", 2.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _removed string, n_chars string, mark double")
    got = line_dedup.without_duplicate_lines(docs)
    assert got.dtypes == docs.dtypes
    got = {r.n_chars: r for r in got.collect()}
    for k, (i, t) in enumerate(kept_lines(rows)):
        r = got[f"n{k}"]
        assert (r.doc_id, r.text, r._removed, r.mark) == (i, t, "keep", 2.5)
    report = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in line_dedup.line_report(docs).collect())
    left = kept_lines(rows)
    n = lambda t: len(line_dedup.lines_of(t))
    assert report == sorted((str(i), n(t), n(t) - n(u)) for (i, t), (_, u) in zip(rows, left))


def test_whole_numbers_of_characters_are_counted_anew(spark):
    docs = spark.createDataFrame([(1, "a line of some length here", 7), (2, "a line of some length here\nx", 9)], "doc_id int, text string, n_chars int")
    got = line_dedup.without_duplicate_lines(docs)
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.collect())) == [(1, "a line of some length here", 7), (2, "x", 1)]
