"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from paceline.plans import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, float) else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    told = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in told.fetchall()]
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
