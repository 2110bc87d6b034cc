"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op") and n != "pipeline"))
def test_query(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(row[columns.index(c)]) for c in df.columns) for row in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql(name, spark, sf):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
