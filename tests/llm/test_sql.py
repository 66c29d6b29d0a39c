"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from quadrille.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))


def test_quotes_match_sql(spark):
    import pandas as pd

    rows = [(1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> how are you?\nFine thanks"), (1, 2, "user", "On Monday, Bob wrote:\n> > How are you?\n> Fine thanks\n\nGood."), (1, 3, "user", "New topic"), (1, 4, "assistant", ">Hello there\n>How are you?\nagain"), (1, 5, "user", "> nothing known\nok"), (2, 0, "user", None), (2, 1, "user", "> Hello there\nx"), (3, 0, "u", "dup"), (3, 1, "u", "dup"), (3, 2, "u", "> dup\nreply"), (3, 3, "u", "> reply\nr2"), (3, 4, "u", "> r2\nr3")]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    con.sql("create table conversations as select * from frame")
    want = con.sql(queries.ORACLE_SQL["op8_quote_threads"].replace(queries._TALKS, "talks AS (SELECT * FROM conversations)"))
    from quadrille.llm import quote_threads

    got = quote_threads.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))


def test_the_registered_conversations_quote(spark):
    got = queries.QUERIES["op8_quote_threads"](spark, SF)
    r = got.selectExpr("count(*) n", "count_if(reply_to is not null) linked", "max(depth) deep", "count_if(n_quoted > 0) quoting").first()
    assert r.linked == r.quoting > r.n / 2 and r.deep == 2
