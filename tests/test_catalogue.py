"""Every query of the library against its DuckDB twin on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lantern.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    answer = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[p]) for p in places) for r in answer.fetchall())
    assert got == expected


def test_each_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
