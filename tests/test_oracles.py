"""Every query with SQL equals it on a small table, and all queries keep their schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(float(v), 9)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v).removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())
