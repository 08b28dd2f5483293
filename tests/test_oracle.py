"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for f in os.listdir(data):
        connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return connection


def rows(df: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return round(v, 9)
        return str(v) if isinstance(v, pd.Timestamp) else v

    names = sorted(df.columns)
    return Counter(tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, data, duck, name):
    got = entry.queries()[name](spark, data).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows_and_every_query_a_name(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
