"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerlark.plans import registry

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def flat(df):
    df = df.reindex(sorted(df.columns), axis=1)
    show = lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(map(tuple, df.map(show).values.tolist())), list(df.columns)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if name in SQL:
        assert flat(got) == flat(con.sql(SQL[name]).df())
