"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from barline import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 9) + 0.0
        return str(x)[:26].removesuffix(" 00:00:00") if hasattr(x, "year") else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    got = plain(df.select(*columns).collect())
    assert got == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
