"""Every registered query that has SQL is held against DuckDB on the tables of sf0.01."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corvane.plans import catalogue

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = sorted(catalogue.oracle_sql())


def _plain(x):
    if pd.isna(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(([_plain(x) for x in r] for r in d[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
