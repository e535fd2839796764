"""Every registered query against its SQL in DuckDB, at the smallest size."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from parley import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(found.columns)
    spark.catalog.clearCache()


def test_names_and_meanings():
    assert set(SQL) <= set(QUERIES)
    assert all(f.__doc__ for f in QUERIES.values())
