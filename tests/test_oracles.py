"""Every query with DuckDB text gives the same rows there."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from opinspark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rounded(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module")
def results(spark, request):
    """Columns and rows of the queries that were asked for, some at a time: most of a small query is planning."""
    names = [i.callspec.params["name"] for i in request.session.items if i.path.name == "test_oracles.py"]

    def run(name):
        got = QUERIES[name](spark, DATA)
        return sorted(got.columns), got.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in names}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(results, duck, name):
    columns, got = results[name].result()
    found = duck.sql(SQL[name])
    assert columns == sorted(found.columns)
    want = sorted(str([rounded(v) for v in r]) for r in found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert sorted(str([rounded(r[c]) for c in columns]) for r in got) == want
