"""Every query runs; those with SQL agree with DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    rows = sorted(([r[c] for c in cols] for r in got.collect()), key=repr)
    other = sorted(([dict(zip(names, r, strict=True))[c] for c in cols] for r in want.fetchall()), key=repr)
    a, b = Counter(map(repr, rows)), Counter(map(repr, other))
    assert rows and len(rows) == len(other)
    assert a == b, (list((a - b))[:3], list((b - a))[:3], sum((a - b).values()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
