"""Near copies by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

from quadrille.llm import shingle_join, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def documents(n=60, words=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(4000)}" for _ in range(words)]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, rng.randrange(4)):
            w[rng.randrange(words)] = f"changed{i}{k}"
            w = w[: len(w) - rng.randrange(3)]
            rows.append((10 * i + k, " ".join(w)))
    return rows + [(9001, ""), (9002, None), (9003, "two words"), (9004, "Two  words"), (9005, "two other")]


def components(rows):
    sets, parent = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_similar():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(30), rng.randint(1, 25))), dtype=np.uint32) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        for least in (0.2, 0.5, 0.8):
            assert shingle_join.similar(a, b, least) == (len(x & y) >= least * len(x | y) - 1e-9)


@pytest.mark.parametrize("block", [1024, 2])
def test_all_similar_pairs_connect(spark, monkeypatch, block):
    from quadrille.llm.components import connected_components

    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = documents()
    links = shingle_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == components(rows)


def test_stage_drops_near_copies(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus.drop_near_copies(spark, df, "").collect()}
    want = components(rows)
    assert kept & set(want) == {i for i, c in want.items() if i == c and i != 9002}  # texts without words are one
    assert {r.doc_id for r in simhash.near_duplicates(df).filter("doc_id = component_id").collect()} - kept
