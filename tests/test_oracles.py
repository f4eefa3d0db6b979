"""Every registered query with a SQL counterpart is compared value by value on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert cols == sorted(names)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in out.collect())
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    out.collect()


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
