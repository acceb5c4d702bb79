"""Every query with a SQL counterpart gives DuckDB's rows; the others run and are checked by their own tests."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from skarn import file_queries, item_queries, lane_queries, more_queries  # noqa: F401 - add to both
from skarn.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return repr(round(float(v), 6) + 0.0) if isinstance(v, numbers.Number) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(sql.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
