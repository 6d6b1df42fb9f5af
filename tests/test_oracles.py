"""Every query of the catalogue against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from folioscope import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else v
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    assert name in SQL
    want = duck.execute(SQL[name])
    assert canonical(got.columns, rows) == canonical([d[0] for d in want.description], want.fetchall())
