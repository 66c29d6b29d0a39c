"""What the pipeline's stages store and shuffle beside the documents themselves."""

import random

import pytest

from quadrille.llm import _spark, shingle_join

corpus = pytest.importorskip("corpus_pipeline")


def test_near_copies_store_no_set_of_a_text_that_meets_none(spark, monkeypatch):
    rng, stored = random.Random(2), []
    put = _spark.materialise

    def seen(df, label, *a):
        out = put(df, label, *a)
        files, where = out.sparkSession._jvm.org.apache.hadoop.fs.Path(out._table_path), out.sparkSession._jsc.hadoopConfiguration()
        stored.append(files.getFileSystem(where).getContentSummary(files).getLength())
        return out

    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(2000))) for i in range(120)]
    rows.append((500, rows[3][1].replace(rows[3][1].split()[7], "changed")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(_spark, "materialise", seen)
    links = {(r.a, r.b) for r in shingle_join.similar_documents(df).collect()}
    assert {tuple(sorted(x)) for x in links} == {(3, 500)}
    assert sum(stored) < 4 * 2000 * 120 / 4  # a quarter of the hashes of all shingles


@pytest.mark.parametrize("kind", ["long", "int"])
def test_without_drops_what_is_listed_and_shuffles_little_else(spark, kind):
    rows = [(i % 90 if i % 10 else None, f"text {i}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, _hash long")
    ids = spark.createDataFrame([(1,), (41,), (41,), (7000,)], "doc_id long")
    out = corpus.without(docs, ids)
    assert out.columns == docs.columns
    assert sorted(r._hash for r in out.collect()) == [n for i, _, n in rows if i not in (1, 41)]
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
