"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

pytest.importorskip("public_tokenizers")
from quadrille.llm import ranked_search  # noqa: E402

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall((text or "").encode())]


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total = len(held)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 25 + 75 * c.total() * total // length
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, doc, -score) for n, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(str, out))


def got(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_ties_nulls_repeats_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(names, k=rng.randint(1, 80)))) for i in range(400)]
    docs += [(1000 + i, "Common COMMON copy!") for i in range(30)] + [(5, "w1 copy"), (None, "copy w2"), (None, None), (2000, ""), (2001, "... !"), (2002, "é copy É 漢 w1"), (2003, "w1 " * 5000)]
    items = [(1, "w1 w2 w3 copy copy"), (1, "w1 w2 w3 copy copy"), (2, ""), (3, None), (None, "w5 W6"), (4, "nothing-known"), (5, "é 漢 w1_w2"), *((10 + i, " ".join(rng.choices(names, k=40))) for i in range(20))]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, score=1, rank="r", term="x") for i, t in docs], "doc_id long, text string, score int, rank string, term string").repartition(7)
    asked = spark.createDataFrame([Row(item_id=i, text=t, doc_id=3) for i, t in items], "item_id long, text string, doc_id long")
    want = plain(docs, items)
    assert got(ranked_search.ranked(frame, asked)) == want
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 8)
    assert got(ranked_search.ranked(frame, asked, block_bytes=300)) == want
    assert got(ranked_search.ranked(frame.limit(0), asked)) == [] == got(ranked_search.ranked(frame, asked.limit(0)))


def test_every_stop_is_proven():
    """Shards by themselves, whatever the step and the threshold they begin with."""
    rng = random.Random(9)
    stopped = 0
    for _ in range(60):
        n, k = rng.randint(1, 400), rng.choice([1, 3, 10])
        counts = [{t: rng.randint(1, 5) for t in rng.sample(range(12), rng.randint(1, 6))} for _ in range(n)]
        table = {}
        for d, c in enumerate(counts):
            for t, tf in c.items():
                table.setdefault(t, {}).setdefault(int(ranked_search.impacts_of(np.array(tf), np.array(sum(c.values())), n, 10 * n)), []).append(d)
        groups, impacts, begins, postings = [0], [], [0], []
        for t in range(12):
            for impact in sorted(table.get(t, {}), reverse=True):
                impacts.append(impact)
                postings += table[t][impact]
                begins.append(len(postings))
            groups.append(len(impacts))
        arrays = [np.arange(n), np.arange(12).astype(np.uint64), np.array(groups, np.int32), np.array(impacts, np.int32), np.array(begins, np.int32), np.array(postings, np.int32)]
        shard = ranked_search.Shard(*(a.tobytes() for a in arrays))
        term = np.array([t for t in rng.sample(range(12), 5) if t in table], dtype=np.int64)
        weight = np.array([rng.choice([1, 40, 9000]) for _ in term], dtype=np.int64)
        score = np.zeros(n, dtype=np.int64)
        for t, w in zip(term, weight):
            for impact, ds in table[t].items():
                score[ds] += w * impact
        best = np.lexsort((np.arange(n), -score))[:k]
        best = best[score[best] > 0]
        ranked_search.FIRST_STEP, before = rng.choice([1, 16, 4096]), ranked_search.FIRST_STEP
        doc, value = shard.best(term, weight, k, 1)
        ranked_search.FIRST_STEP = before
        stopped += shard._by_document is not None
        assert set(best) <= set(doc.tolist()) and (score[doc] == value).all()
        doc, value = shard.best(term, weight, k, least := int(np.median(score)) + 1)
        assert {d for d in best if score[d] >= least} <= set(doc.tolist())
    assert stopped > 5
