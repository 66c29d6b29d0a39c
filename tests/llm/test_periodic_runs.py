"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

pytest.importorskip("public_tokenizers")
from quadrille.llm import periodic_runs, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_runs(s, shortest):
    n, out = len(s), set()
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if s[k] != s[k + p]:
                k += 1
                continue
            a = k
            while k + p < n and s[k] == s[k + p]:
                k += 1
            part = s[a : k + p]
            if k - a >= p and len(part) >= shortest and not any(part[:-q] == part[q:] for q in range(1, p)):
                out.add((a, len(part), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_random_sequences():
    rng = random.Random(5)
    for _ in range(3000):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5 and n > 3:
            p, a = rng.randint(1, 8), rng.randrange(n)
            s = [s[a + (i - a) % p] if i >= a and a + (i - a) % p < n else s[i] for i in range(n)]
        shortest = rng.choice([2, 4, 12])
        assert periodic_runs.find_runs(np.array(s, dtype=np.int64), shortest) == plain_runs(s, shortest)


def test_hashes_that_meet_are_verified(monkeypatch):
    monkeypatch.setattr(periodic_runs.Extensions, "_same", lambda self, a, b, m: True)
    rng = random.Random(6)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        assert periodic_runs.find_runs(np.array(s, dtype=np.int64), 4) == plain_runs(s, 4)


def test_very_long_texts_take_time_in_proportion():
    began = time.time()
    assert periodic_runs.find_runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs(np.arange(200_000) % 7) == [(0, 200_000, 7)]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(periodic_runs.find_runs(np.array(b))) > 10_000
    assert time.time() - began < 120


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_a_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 700]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == 200 and len(rows) > 150
    for doc_id, text in rows:
        assert got[doc_id] == expected(doc_id, text)


def test_odd_rows(spark, tmp_path):
    tenth = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = " ".join(f"w{i}" for i in range(90))
    rows = [(1, None), (2, ""), (3, " \n\t\v"), (4, "a " * 40), (5, "a b\tc\n" * 9 + "x y"), (None, "q r " * 12), (None, words), (tenth, words), (tenth, words), (tenth, ""), (tenth, None), (6, "é 漢 " * 8), (6, "other"), (7, "a a " * 14), (8, "ab\x00 " * 13)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, runs="x", n_words=5, collapsed=1, best=2) for i, t in rows], "doc_id long, text string, runs string, n_words int, collapsed int, best int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())))
    assert got == sorted(str(expected(i, t)) for i, t in rows)
    real = {r.doc_id: r for r in periodic_runs.periodic_runs(docs.filter("doc_id = 5")).collect()}[5]
    assert real.n_words == 29 and [tuple(r) for r in real.runs] == [(0, 27, 3)] and real.collapsed == "a b c x y"
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
