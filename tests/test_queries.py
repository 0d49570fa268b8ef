"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, sql, name):
    df = entry_points.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    oracle = entry_points.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    cursor = sql.execute(oracle)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), names)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
