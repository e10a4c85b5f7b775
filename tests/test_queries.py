"""Every registered record query against the same in SQL on an independent engine."""

import datetime
import glob
import os

import duckdb
import pytest

from recordweave.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return v.isoformat(" ") if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in queries.ORACLES:
        assert rows
        return
    x = duck.sql(queries.ORACLES[name])
    assert sorted(x.columns) == cols
    at = [x.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in x.fetchall())
