"""Null ids, and labels that contradict each other."""

import pytest

pytest.importorskip("public_tokenizers")
from quadrille.llm import language_id, phrase_index, toxicity  # noqa: E402


def test_rows_without_an_id_are_scored_and_not_held_out(spark):
    docs = spark.createDataFrame([(i, "plain words of this language" if i % 2 else "andere worte dieser sprache", "en" if i % 2 else "de") for i in range(60)] + [(None, "plain words", "en"), (None, None, None)], "doc_id long, text string, lang string")
    got = [r for r in language_id.language_id(docs).collect() if r.doc_id is None]
    assert sorted((r.held_out, r.lang_pred) for r in got) == [(False, "en"), (False, "und")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r.doc_id is None]
    assert [r.held_out for r in got] == [False, False] and all(0 <= r.score <= 1 for r in got)


def test_contradicting_labels_are_toxic_whatever_their_order(spark):
    rows = [(i, ("bad nasty words here " if i % 3 == 0 else "good kind words there ") * (1 + i % 4)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, int(i % 3 == 0)) for i, _ in rows] + [(i, 0) for i, _ in rows if i % 6 == 0]
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(m, "doc_id long, toxic int").repartition(n)).collect())) for m, n in ((marks, 1), (marks[::-1], 5)))
    assert a == b and {r[0] for r in a if r[3]} == {i for i, _ in rows if i % 3 == 0}


def test_rows_without_an_item_id_are_no_items(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (7, "three four")], "item_id long, text string")
    r = phrase_index.contamination(docs, items).first()
    assert (r.n_hit, r.n_items) == (2, 1) and phrase_index.items_digest(["7"]) == r.items_sha256
