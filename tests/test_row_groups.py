"""Stored indexes hold few shards a row group, so that no task's memory grows with its part of the input."""

import glob

import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")
from quadrille.llm import phrase_index, ranked_search  # noqa: E402


def groups(table):
    (file,) = glob.glob(f"{table._table_path}/*.parquet")
    m = pq.ParquetFile(file).metadata
    return [m.row_group(i) for i in range(m.num_row_groups)]


def test_shards_have_row_groups_of_their_own(spark):
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a batch is a shard at least
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "concat('word', id, ' of ', id % 7) AS text")
    try:
        for index, most in ((ranked_search.store_index(docs, 300, 900), 1), (phrase_index.store_index(docs), 8)):
            held = groups(index)
            assert sum(g.num_rows for g in held) == index.count() == 30 and max(g.num_rows for g in held) <= most
            assert not any(g.column(i).is_stats_set and g.column(i).statistics.has_min_max for g in held for i in range(g.num_columns))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
