"""Daily cell states, exact quantiles and the as-of join against plain computations."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, det_df
from tracklens.operators import cellstates as CS
from tracklens.operators.asof import asof_join
from tracklens.operators.filters import period_filter
from tracklens.operators.heatmap import heatmap
from tracklens.operators.quantiles import exact_quantiles
from tracklens.params import Period
from tracklens.sources.detections import normalise
from tracklens.sources.events_view import detections_from_events


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# ---- daily states


@pytest.fixture(scope="module")
def det(spark):
    return normalise(detections_from_events(spark, SF_SMALL))


def test_a_week_of_stored_days_is_the_direct_heatmap(spark, det, tmp_path):
    path = str(tmp_path / "states")
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-31")):  # stored in two runs
        part = period_filter(det, Period(f"{first}T00:00:00", f"{last}T23:59:59.999999"))
        CS.store_days(CS.daily_states(part, 4), path)
    week = CS.stored_days(spark, path, date(2024, 1, 8), date(2024, 1, 14))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    direct = period_filter(det, Period("2024-01-08T00:00:00", "2024-01-14T23:59:59.999999"))
    assert len(week.inputFiles()) >= 7
    for least in (1, 2):
        assert rows(CS.heatmap_of_states(week, least)) == rows(heatmap(direct, 4, least))


def test_storing_a_day_again_replaces_it_and_no_other(spark, tmp_path):
    path = str(tmp_path / "states")
    point = {"longitude": "1", "latitude": "2", "object_type": "small", "device_identifier": "d"}
    both = [{"track_identifier": "a", "timestamp": f"2024-01-0{d}T10:00:00", "speed": "1", **point} for d in (1, 2)]
    CS.store_days(CS.daily_states(det_df(spark, both)), path)
    again = [{"track_identifier": t, "timestamp": "2024-01-02T11:00:00", "speed": "3", **point} for t in ("b", "c")]
    again += [{"track_identifier": "x", "timestamp": None, **point}, {"track_identifier": "y", "timestamp": "2024-01-02T11:00:00", "longitude": "bad"}]
    CS.store_days(CS.daily_states(det_df(spark, again)), path)
    (cell,) = CS.heatmap_of_states(CS.stored_days(spark, path, date(2024, 1, 1), date(2024, 1, 2))).collect()
    assert (cell.point_count, cell.avg_speed, cell.first_seen.day, cell.last_seen.hour) == (3, 5.2, 1, 11)
    (cell,) = CS.heatmap_of_states(CS.stored_days(spark, path, date(2024, 1, 1), date(2024, 1, 1))).collect()
    assert cell.point_count == 1


def test_sketches_estimate_tracks(spark, det):
    exact = {r.device_id: r.point_count for r in heatmap(det, 0).groupBy("device_id").agg(F.max("point_count").alias("point_count")).collect()}
    got = CS.heatmap_of_sketches(CS.daily_sketches(det, 0)).groupBy("device_id").agg(F.max("point_count").alias("n")).collect()
    assert all(abs(r.n - exact[r.device_id]) <= max(1, 0.05 * exact[r.device_id]) for r in got)


# ---- quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("bins", [2, 64, 4096])
def test_quantiles(spark, bins):
    rng = random.Random(4)
    data = {
        "plain": [rng.gauss(30, 9) for _ in range(800)],
        "ties": [1.5] * 500 + [2.5] * 3,
        "one": [7.25],
        "wide": [s * 10.0**e for e in range(-300, 301, 60) for s in (-1, 1, 3)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
        None: [rng.random() for _ in range(99)],
        "none": [],
    }
    if bins == 2:  # a round halves a range at best
        data = {k: v for k, v in data.items() if k in ("ties", "one")} | {"few": data["plain"][:20]}
    table = [(k, x) for k, v in data.items() for x in v] + [("none", None), ("none", float("nan")), ("one", float("inf")), ("one", None)]
    df = spark.createDataFrame(table, "kind string, v double").repartition(3)
    got = {r.kind: r for r in exact_quantiles(df, "kind", "v", PROBS, bins).collect()}
    assert set(got) == {k for k, v in data.items() if v}
    for k, r in got.items():
        s = sorted(data[k])
        assert (r["count"], r.min, r.max) == (len(s), s[0], s[-1])
        for p, q in zip(PROBS, r.quantiles, strict=True):
            pos = p * (len(s) - 1)
            a, b = s[int(np.floor(pos))], s[int(np.ceil(pos))]
            assert q == a + (b - a) * (pos - np.floor(pos)) or (np.isinf(b - a) and not np.isfinite(q)), (k, p)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "kind string, v double"), "kind", "v", [0.5]).collect() == []


# ---- as-of join


@pytest.mark.parametrize("chunk_us", [1, 7, 1000, 10**9])
def test_asof(spark, chunk_us):
    rng = random.Random(chunk_us)
    seen = [(rng.choice("abc"), rng.randrange(200), i, rng.choice([None, i * 1.0])) for i in range(150)]
    seen += [(None, 5, 500, 1.0), ("a", None, 501, 2.0)] + [("hot", t, 600 + t, 0.5) for t in range(300)]
    asked = [(i, rng.choice(["a", "b", "c", "hot", "d", None]), rng.choice([None, *range(-5, 330)]), "clash") for i in range(200)]
    asked += asked[:3]
    left = spark.createDataFrame(asked, "id long, k string, t long, v_other string")
    right = spark.createDataFrame(seen, "k string, at long, tie long, v double").repartition(3)
    got = asof_join(left, right, "k", "t", "at", "tie", ["v", "tie"], chunk_us).collect()
    by_key = defaultdict(list)
    for k, at, tie, v in seen:
        if k is not None and at is not None:
            by_key[k].append((at, tie, v))

    def plain(k, t):
        known = [x for x in by_key[k] if t is not None and x[0] <= t]
        return max(known, key=lambda x: x[:2]) if known else (None, None, None)

    want = [(i, k, t, o, *(plain(k, t)[j] for j in (0, 2, 1))) for i, k, t, o in asked]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_asof_of_empty_tables(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")
    none = spark.createDataFrame([], "k string, at long, tie long, v double")
    assert [tuple(r) for r in asof_join(left, none, "k", "t", "at", "tie", ["v"]).collect()] == [(1, "a", 5, None, None)]
    assert asof_join(left.limit(0), none, "k", "t", "at", "tie", ["v"]).collect() == []
