"""A training-corpus pipeline: each stage calls one operator on all that the stage before it kept.

Null and empty texts are texts without words: they pass every stage but near_dedup, which keeps one of all documents
without words; very long texts are read whole; rows that repeat a doc_id are kept or dropped together, and rows with a
null doc_id are kept; an empty table stays empty; extra columns of documents are carried through all but the last stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import _bitmap, _spark, line_dedup, phrase_index, sentence_pieces, shingle_join, simhash, toxicity
from quadrille.llm.components import connected_components


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among `ids`; only rows that a bitmap of the ids doesn't rule out are joined."""
    gone = _spark.materialise(ids.select("doc_id").distinct(), "gone")
    some, rest = _bitmap.split(docs, gone)
    return rest.union(some.join(gone, "doc_id", "left_anti").select(*docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't predict to be toxic; the columns stay."""
    scored = toxicity.toxicity(docs, _spark.table(spark, sf_dir, "labels"))
    return without(docs, scored.filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each near-duplicate line stays where it first stands; a document keeps its other lines."""
    return line_dedup.without_duplicate_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each component of near copies.

    Two documents link if their fingerprints are within 4 bits, or if the Jaccard similarity of their five-word
    shingles is at least 0.8. Documents that have no words after the line stage share fingerprint zero and so count
    as copies of each other."""
    near = simhash.near_duplicates(docs).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    groups = connected_components(near.union(shingle_join.similar_documents(docs))).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return without(docs, groups.filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = phrase_index.contamination(docs, _spark.table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return sentence_pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentence_pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again, over the whole documents table; a stage's table goes when the next one stands."""
    docs = before = _spark.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = _spark.materialise(stage(spark, before, sf_dir), f"stage-{name}")
        if k:
            _spark.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
