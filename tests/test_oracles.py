"""Every registered query against its SQL oracle on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import shape_rows  # noqa: E402


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(SMALL + "/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in oracle_sql():
        assert rows
        return
    result = db.execute(oracle_sql()[name])
    assert shape_rows(df.columns, rows) == shape_rows([c[0] for c in result.description], result.fetchall())


def test_every_oracle_has_a_query():
    assert not set(oracle_sql()) - set(queries())


def test_entry(spark):
    assert entry(spark).collect()[0]["corr"] is not None
