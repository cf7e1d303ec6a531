import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sheetwise.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "sheetwise-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    def load(name):
        return spark.read.parquet(f"{SMALL}/{name}.parquet")

    return load


@pytest.fixture(scope="session")
def gdp(spark):
    """The eleven-country sample table; Russia's zero index is the division case."""
    rows = [
        ("United States", 19294482071552, 2),
        ("United Kingdom", 2891615567872, 1),
        ("France", 2411255037952, 8),
        ("Germany", 3435817336832, 3),
        ("Italy", 1745433788416, 4),
        ("Spain", 1181205135360, 4),
        ("Canada", 1607402389504, 9),
        ("Australia", 1490967855104, 10),
        ("Japan", 4380756541440, 5),
        ("China", 14631844184064, 30),
        ("Russia", 3, 0),
    ]
    return spark.createDataFrame(rows, "country string, gdp long, happiness_index int")


def rows_of(df, *cols):
    """Rows as sorted tuples, for comparisons without order."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
