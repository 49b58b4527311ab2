"""Every query with SQL gives the bag of rows that DuckDB gives on the same files; the others run."""

import decimal
import glob
import os

import duckdb
import pytest

from tallyhouse.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def text(value):
    return str(value) if isinstance(value, decimal.Decimal) else repr(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(text(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    rows = found.collect()
    if name in ORACLE_SQL:
        told = duck.sql(ORACLE_SQL[name])
        assert bag(found.columns, rows) == bag(told.columns, told.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
