"""Every registered query of the engine against its DuckDB equivalent, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from palimpsest.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return None if value != value else int(value) if value == int(value) else round(float(value), 6)
    return int(value) if isinstance(value, (int, np.integer)) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False)), columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got, columns = rows(catalogue.queries()[name](spark, SF).toPandas())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    expected, named = rows(duck.execute(sql).fetchdf())
    assert columns == named
    assert got == expected
