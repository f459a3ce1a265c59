"""Every registered query against SQL on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in found.collect()]
    assert rows
    expected = duck.execute(ORACLES[name])
    assert comparable(found.columns, rows) == comparable([c[0] for c in expected.description], expected.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["visit_day", "visits", "engaged"]


def test_no_oracle_without_a_query():
    assert set(ORACLES) <= set(QUERIES)
