"""Every query with SQL gives the rows that a second engine gives."""

import collections
import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from unifold.plans.oracle import oracle_sql


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def engine(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, small, engine, name):
    a = entry.queries()[name](spark, small).toPandas()
    b = engine.execute(oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [collections.Counter(tuple(map(plain, r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
