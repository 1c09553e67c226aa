"""Every query with SQL gives the same rows in Spark and in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from watchglass.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(float(x) if type(x).__name__ == "Decimal" else x for x in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    if name in SQL:
        chosen = ", ".join(f'"{c}"' for c in columns)
        assert plain(got) == plain(duck.execute(f"SELECT {chosen} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
