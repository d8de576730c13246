"""Every query with an oracle gives the oracle's rows at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from rasterloom.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(tiny):
        con.sql(f"create view {name.split('.')[0]} as select * from '{tiny}/{name}'")
    return con


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in data))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, tiny, name):
    df = catalog.queries()[name](spark, tiny)
    got = df.collect()
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
