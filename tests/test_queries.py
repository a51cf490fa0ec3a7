"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from cleanframe import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None or isinstance(v, (int, str, bool)) else str(v) if not hasattr(v, "as_tuple") else float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cursor = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
