"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from cairn.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Queries that find nothing in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(repr([value(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    assert got or name in EMPTY
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_flagship(spark):
    df = registry.flagship(spark, DATA)
    assert df.columns == ["n_name", "n_customers", "balance"]
    assert df.count() > 0
