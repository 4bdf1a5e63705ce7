"""Every registered query of the engine's own operators against its SQL on DuckDB, at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loamspark import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
        return str(list(x))
    return "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, DATA).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    got = plans.queries()[name](spark, DATA)
    assert len(got.columns) == len(set(got.columns))
    got.count()
