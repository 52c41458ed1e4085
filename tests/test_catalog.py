"""Every registered query against its SQL, run on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_points

ROOT = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, ROOT)
    found = frame.collect()
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert table_of(frame.columns, found) == table_of(columns, cursor.fetchall())
    assert found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"fc_gbt"}))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, ROOT).count() > 0


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["section", "label", "month_num", "total_sales"]
    assert frame.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
