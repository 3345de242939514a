"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from provloom.plans import artifacts, checks, compositions, graphs, records, relational, routes, semantics, traces, validation  # noqa: F401
from provloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(rows):
    fix = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted((tuple(fix(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    rows = [tuple(r) for r in expected[names].astype(object).itertuples(index=False, name=None)]
    assert plain(tuple(r) for r in got.select(names).collect()) == plain(rows)
