"""The pipeline over small tables: every stage's decision against a plain one on the stage's own input."""

import re

import pytest
import xxhash

pytest.importorskip("public_tokenizers")
corpus = pytest.importorskip("corpus_pipeline")

from quadrille.llm import _spark, line_dedup, phrase_index, toxicity  # noqa: E402
from test_operators import plain_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus.STAGES[:-1]:
        before, kept = kept, _spark.materialise(stage(spark, kept, SF), name)
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        had = {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(before, _spark.table(spark, SF, "labels")).filter("predicted = 0").collect()}
        elif name == "line_dedup":
            want = had
            assert line_dedup.line_report(kept).agg({"n_removed": "sum"}).first()[0] == 0
        elif name == "near_dedup":
            want = had - plain_near_copies([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
        else:
            want = {r.doc_id for r in phrase_index.contamination(before, _spark.table(spark, SF, "benchmark")).filter("not contaminated").collect()}
        assert ids == want and ids
    last = corpus.STAGES[-1][1](spark, kept, SF).collect()
    assert len(last) == kept.count() and all(r.round_trip for r in last)


def plain_near_copies(rows):
    """doc_ids that go: all but the least of each group linked by fingerprints within 4 bits or five-word Jaccard of 0.8."""
    fps, sets = {}, {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        cut = lambda n: [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) > n else [b" ".join(w)] if w else []  # noqa: B023
        h = [xxhash.xxh64_intdigest(x, 42) for x in cut(4)]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        sets[i] = set(cut(5))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 4 or both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) != i}


def test_run_against_plain_stages(spark):
    """The rows of the whole pipeline: toxicity's decisions as given (its scores have a test of their own), every later stage said plainly."""
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in toxicity.toxicity(docs, _spark.table(spark, SF, "labels")).filter("predicted = 0").join(docs, "doc_id").select("doc_id", "text").collect()]
    gone = plain_lines(rows)
    rows = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, t in rows]
    copies = plain_near_copies(rows)
    rows = [(i, t) for i, t in rows if i not in copies]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in _spark.table(spark, SF, "benchmark").collect() for w in [split(r.text)] for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    clean = [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))]
    assert gone and copies and len(clean) < len(rows)
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, tuple(m.encode(t or ""))) for i, t in clean)
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus.run(spark, SF).select("doc_id", "ids").collect()) == want


def test_odd_tables_pass_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    odd = [(None, None, None, None, None, "a"), (5, "same text here for all of us", "en", None, None, "b"), (5, "same text here for all of us", "en", None, None, "b"), (6, "", "en", "s", 0, "c")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert corpus.STAGES[-1][1](spark, docs, SF).count() == len(rows)
