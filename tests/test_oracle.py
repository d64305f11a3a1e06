"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import key_rows  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

# the training-data operators have tests of their own
MORE = re.compile(r"op\d+_.*|pipeline")
QUERIES = {k: q for k, q in E.queries().items() if not MORE.fullmatch(k)}
ORACLE = {k: q for k, q in E.oracle_sql().items() if not MORE.fullmatch(k)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["bin_start", "object_type", "count"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = key_rows(df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = key_rows([tuple(r[i] for i in idx) for r in rel.fetchall()])
    assert got == want
