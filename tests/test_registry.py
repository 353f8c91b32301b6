"""Every registered query with an oracle gives the oracle's rows."""

import glob
import math
import os

import duckdb
import pytest

from tracemill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.8g}"
    return str([cell(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_against_oracle(spark, duck, key):
    frame = registry.QUERIES[key](spark, SF)
    names = sorted(frame.columns)
    wanted = duck.sql(registry.ORACLES[key])
    assert names == sorted(wanted.columns)
    at = [wanted.columns.index(n) for n in names]
    right = sorted(tuple(cell(row[k]) for k in at) for row in wanted.fetchall())
    found = sorted(tuple(cell(row[n]) for n in names) for row in frame.collect())
    close = lambda a, b: a == b or (a != "~" != b and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-9))
    assert len(found) == len(right)
    for x, y in zip(found, right, strict=True):
        assert all(close(a, b) for a, b in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, key):
    assert registry.QUERIES[key](spark, SF).columns
