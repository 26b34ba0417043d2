"""Every query of the core with SQL against DuckDB on the smallest tables, and that the package stands without extras."""

import collections
import datetime
import decimal
import os

import pytest

from papyrine.plans import catalog


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = collections.Counter(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    got = collections.Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    assert catalog.queries()[name](spark, folder).count() >= 0


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
