"""Every query against its SQL on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from quadrille.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or (not isinstance(v, str) and not hasattr(v, "__len__") and pd.isna(v)):
            return "~"
        return f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
