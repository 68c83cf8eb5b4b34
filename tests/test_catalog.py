"""Every registered query against the same rows from an independent SQL engine."""

import math

import duckdb
import pandas as pd
import pytest

from gridloom.plans import catalog


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, str):
            return x
        return round(float(x), 9)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{data}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    assert rows(catalog.QUERIES[name](spark, data).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())
