"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from reelframe.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    there = duck.sql(queries.SQL[name])
    assert sorted(there.columns) == columns
    wanted = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(wanted)
