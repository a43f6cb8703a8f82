"""Every query of the library beside its SQL, over the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from tsunagi import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(cols, found):
    return Counter(tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in found), cols


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    got = df.collect()
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert rows(cols, ([r[c] for c in cols] for r in got)) == rows(cols, want)


def test_entry_runs_without_the_optional_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())
