"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from heliogrid.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    a = tidy(catalogue.QUERIES[name](spark, SF).toPandas())
    b = tidy(duck.execute(catalogue.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-5, rtol=1e-9, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
