"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    mine = table([tuple(r) for r in result.collect()], result.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(result.columns)
    assert mine == table(found.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
