"""The search index gives what the plain search gives, from a part of the index."""

from __future__ import annotations

import pytest

from tracklens.plans.rollups import raw_search
from tracklens.plans.search import SearchIndex

WORDS = ["dev-1", "Pedestrian", "vehicle", "née", "Éa", "a b", "x_y", "12.50", "under-ground", "ground", None, "", "  ", "(odd)", "veh" * 30]
QUERIES = [
    "", " ", "dev", "DEV-1", "1", "ped vehicle", "ground", "under", "née", "éa", "y", "b", ".", "(odd", "12.5", "2.5", "veh" * 7, "veh" * 31,
    "vehicle 3", "nothing", "3 3", "\U0010ffff",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(w, WORDS[(i * 7 + 3) % len(WORDS)], float(i) if i % 3 else None, i % 4) for i, w in enumerate(WORDS * 3)]
    return spark.createDataFrame(rows, "`Type` string, `The Device` string, `Avg Speed` double, n long").repartition(3)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return SearchIndex.build(table, str(tmp_path_factory.mktemp("index")))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows(table, index, query):
    assert index.search(query).columns == table.columns
    assert rows(index.search(query)) == rows(raw_search(table, query))


def test_a_term_is_a_range_of_the_index(index):
    plan = index.matches("Ground")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "GreaterThanOrEqual(token,ground)" in scan and "LessThan(token,groune)" in scan


def test_empty_table(spark, table, tmp_path):
    assert SearchIndex.build(table.limit(0), str(tmp_path)).search("dev").collect() == []
