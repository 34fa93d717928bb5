"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
import workload
from tools.check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLES) and set(workload.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", workload.QUERIES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    duck.sql(f"create or replace temp view oracle as {entry.oracle_sql()[name]}")  # as a view, like in other checkers
    result = duck.sql("from oracle")
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(result.columns, result.fetchall())
