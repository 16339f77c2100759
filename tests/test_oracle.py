"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tilescape.plans.fixtures import TABLES

QUERIES, ORACLE = queries(), oracle_sql()
CHECKED = sorted(ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship_entry(spark):
    from __spark_entry__ import entry
    assert entry(spark).count() > 0
