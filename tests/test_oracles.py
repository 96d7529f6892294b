"""Every core query against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def text(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    if isinstance(v, (float, np.floating)):
        return repr(float(v)) if v != int(v) else str(int(v))
    if isinstance(v, datetime.date):
        return str(v)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
    else:
        assert rows(got) == rows(con.sql(sql).df())
