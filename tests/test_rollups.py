"""Page-level roll-ups on small hand-made result tables."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import det_df
from tracklens.operators.filters import period_filter
from tracklens.params import Period
from tracklens.plans.rollups import (
    bounds,
    histogram_columns,
    hex_density,
    raw_search,
    rose_bins,
    speed_box_stats,
    speed_whiskers,
    summary_by_filter,
    zone_rollup,
)

ROSE_SCHEMA = "direction string, object_type string, count long, speed_sum double, avg_speed double"


def test_rose_bins_zero_fill_and_means(spark):
    rose = spark.createDataFrame(
        [("N", "pedestrian", 2, 10.0, 5.0), ("N", "vehicle", 1, 30.0, 30.0), ("SE", "vehicle", 4, 8.0, 2.0),
         (None, "vehicle", 3, 9.0, 3.0)],
        ROSE_SCHEMA,
    )
    bins = {r.label: r for r in rose_bins(rose).collect()}
    assert list(bins) == ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    assert (bins["N"].pedestrian, bins["N"].vehicle, bins["N"].total) == (2, 1, 3)
    assert bins["N"].pedAvgSpeed == 5.0 and bins["N"].vehAvgSpeed == 30.0
    assert bins["N"].avgSpeed == pytest.approx(40.0 / 3)
    assert bins["E"].total == 0 and bins["E"].avgSpeed == 0.0
    veh = {r.label: r for r in rose_bins(rose, "Vehicle").collect()}
    assert veh["N"].pedestrian == 0 and veh["SE"].vehicle == 4


def test_zone_rollup(spark):
    zs = spark.createDataFrame(
        [("freight_yard", "pedestrian", 1, 0.0, 0.0), ("freight_yard", "vehicle", 2, 0.0, 0.5),
         ("gate_1", "vehicle", 3, 0.0, None)],
        "zone string, object_type string, detections long, avg_speed double, speed_sum double",
    )
    got = {r.zone: r for r in zone_rollup(zs).collect()}
    assert got["freight yard"].detections == 3
    assert got["freight yard"].avg_speed == 0.2  # 0.5 / 3 = 0.1666 -> 0.2
    assert (got["freight yard"].pedestrian_pct, got["freight yard"].vehicle_pct) == (33, 67)
    assert got["gate 1"].avg_speed == 0.0 and got["gate 1"].vehicle_pct == 100


def test_summary_by_filter(spark):
    cols = {
        "total_detections": 10, "pedestrian_count": 5, "vehicle_count": 6,
        "avg_speed": 3.0, "top_speed": 9.0, "ped_avg_speed": 2.0, "ped_top_speed": 4.0,
        "veh_avg_speed": 5.0, "veh_top_speed": 9.0, "peak_hour": "07:00", "zones_active": 4,
    }
    for t in ("all", "pedestrian", "vehicle"):
        for c in ("North", "South", "East", "West"):
            cols[f"dir4_{t}_{c}"] = {"all": 4, "pedestrian": 1, "vehicle": 3}[t]
    summ = spark.createDataFrame([tuple(cols.values())], list(cols))
    period = Period("2024-01-08T00:00:00", "2024-01-08T04:00:00")
    got = {r.filter: r for r in summary_by_filter(summ, period).collect()}
    assert (got["All"].pedestrian_pct, got["All"].vehicle_pct) == (50, 60)
    assert got["All"].flow_rate_per_hour == 3  # 10 / 4 = 2.5 -> 3 (halves up)
    assert (got["Pedestrian"].total_detections, got["Pedestrian"].vehicle_count) == (5, 0)
    assert got["Pedestrian"].pedestrian_pct == 100 and got["Pedestrian"].avg_speed == 2.0
    assert got["Vehicle"].dir_North == 3 and got["Vehicle"].peak_hour == "07:00"


def test_box_stats_and_whiskers(spark):
    rng = np.random.default_rng(3)
    ped = np.round(rng.gamma(2.0, 1.5, 101), 1).tolist() + [40.0]
    veh = np.round(rng.normal(20, 3, 57), 1).tolist()
    rows = [(f"p{i}", "pedestrian", float(v)) for i, v in enumerate(ped)]
    rows += [(f"v{i}", "vehicle", float(v)) for i, v in enumerate(veh)]
    sp = spark.createDataFrame(rows, "track_id string, object_type string, avg_speed double")
    box = {r.object_type: r for r in speed_box_stats(sp).collect()}
    for cls, vals in (("pedestrian", ped), ("vehicle", veh)):
        q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])  # linear interpolation
        b = box[cls]
        assert (b.min, b.max, b["count"]) == (min(vals), max(vals), len(vals))
        assert b.q1 == pytest.approx(q1, abs=1e-6) and b.median == pytest.approx(med, abs=1e-6)
        assert b.q3 == pytest.approx(q3, abs=1e-6)
    wh = {r.object_type: r for r in speed_whiskers(sp).collect()}
    b = box["pedestrian"]
    lo, hi = b.q1 * 2.5 - b.q3 * 1.5, b.q3 * 2.5 - b.q1 * 1.5
    inside = [v for v in ped if lo <= v <= hi]
    assert wh["pedestrian"].whisker_high == max(inside) and wh["pedestrian"].whisker_low == min(inside)
    assert wh["pedestrian"].outliers == len(ped) - len(inside) >= 1


def test_bounds_hex_and_histogram(spark):
    cells = spark.createDataFrame(
        [(-1.0890, 50.8100, 3), (-1.08901, 50.81001, 2), (-1.0800, 50.8200, 1)],
        "lon double, lat double, point_count long",
    )
    b = bounds(cells).collect()[0]
    assert (b.min_lon, b.max_lon, b.max_lat) == (-1.08901, -1.08, 50.82)
    hexes = hex_density(cells, 10).collect()
    assert sum(h.weight for h in hexes) == 6 and sum(h.cells for h in hexes) == 3
    assert len(hexes) == 2  # the two cells ~1.3 m apart share a hexagon
    tl = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-08 00:00:00', 'pedestrian', 2L),"
        " (TIMESTAMP_NTZ'2024-01-08 00:05:00', 'vehicle', 3L),"
        " (TIMESTAMP_NTZ'2024-01-07 23:55:00', 'vehicle', 7L),"
        " (TIMESTAMP_NTZ'2024-01-08 01:00:00', 'vehicle', 1L) AS t(bin_start, object_type, count)"
    )
    t0 = 1704672000000  # 2024-01-08T00:00:00Z in ms
    rng = spark.createDataFrame([(t0, t0 + 3_600_000, 3_600_000)], "time_min_ms long, time_max_ms long, time_range_ms long")
    cols = {r.column: (r.pedestrian, r.vehicle) for r in histogram_columns(tl, rng, 12).collect()}
    # the bin before the origin and the bin at the very end fall outside
    assert cols == {0: (2, 0), 1: (0, 3)}


def test_raw_search(spark):
    cells = spark.createDataFrame(
        [("pedestrian", "dev-1"), ("vehicle", "dev-1"), ("pedestrian", "dev-2"), ("pedestrian", "xdev-1")],
        "object_type string, device_id string",
    )
    t = cells.selectExpr("object_type AS Type", "device_id AS Device")
    assert raw_search(t, "dev-1 PED").count() == 1
    assert raw_search(t, "").count() == 4
    assert raw_search(t, "vehicle").count() == 1


def test_half_open_period(spark):
    rows = [dict(track_identifier="a", object_type="small", timestamp="2024-01-08T00:00:00"),
            dict(track_identifier="a", object_type="small", timestamp="2024-01-09T00:00:00")]
    det = det_df(spark, rows)
    closed = Period("2024-01-08T00:00:00", "2024-01-09T00:00:00")
    half = Period("2024-01-08T00:00:00", "2024-01-09T00:00:00", end_inclusive=False)
    assert period_filter(det, closed).count() == 2 and period_filter(det, half).count() == 1
    zulu = Period("2024-01-08T00:00:00Z", "2024-01-08T23:59:59Z")
    assert period_filter(det, zulu).count() == 1


def test_approximate_quartiles_are_close(spark):
    rng = np.random.default_rng(5)
    vals = rng.gamma(2.0, 3.0, 2000).tolist()
    sp = spark.createDataFrame([(f"t{i}", "vehicle", float(v)) for i, v in enumerate(vals)],
                               "track_id string, object_type string, avg_speed double")
    ex = speed_box_stats(sp).collect()[0]
    ap = speed_box_stats(sp, exact=False).collect()[0]
    spread = max(vals) - min(vals)
    for k in ("q1", "median", "q3"):
        assert abs(ex[k] - ap[k]) < 0.01 * spread


def test_approximate_heatmap_counts(spark):
    from conftest import SF_SMALL
    from tracklens.operators.heatmap import heatmap
    from tracklens.sources.detections import normalise
    from tracklens.sources.events_view import detections_from_events

    det = normalise(detections_from_events(spark, SF_SMALL))
    key = ["lon", "lat", "raw_type", "device_id"]
    ex = {tuple(r[k] for k in key): r.point_count for r in heatmap(det, 4).collect()}
    ap = {tuple(r[k] for k in key): r.point_count for r in heatmap(det, 4, approx_distinct=True).collect()}
    assert ex.keys() == ap.keys()
    assert sum(abs(ex[k] - ap[k]) for k in ex) <= 0.05 * sum(ex.values())


def test_raw_search_numbers_print_like_the_page(spark):
    t = spark.createDataFrame([("a", 3.0), ("b", 3.25)], "Type string, Speed double")
    assert raw_search(t, "3").count() == 2
    assert raw_search(t, "3.0").count() == 0  # shown as "3"
    assert raw_search(t, "3.2").count() == 1


def test_histogram_zero_span(spark):
    tl = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-08 00:00:00' AS bin_start, 'vehicle' AS object_type, 1L AS count")
    t0 = 1704672000000
    rng = spark.createDataFrame([(t0, t0, 0)], "time_min_ms long, time_max_ms long, time_range_ms long")
    assert histogram_columns(tl, rng, 10).count() == 0


def test_hexagons_of_several_radii_are_those_of_each(spark):
    from tracklens.plans.rollups import hex_densities

    points = [(-1.09 + i % 37 * 3e-5, 50.81 + i * 7 % 41 * 2e-5, i % 5 + 1) for i in range(300)]
    cells = spark.createDataFrame(points, "lon double, lat double, point_count long")
    radii = [5, 10, 50]
    every = {r: [] for r in radii}
    for row in hex_densities(cells, radii).collect():
        every[row.radius_m].append(tuple(row)[1:])
    for r in radii:
        assert sorted(every[r]) == sorted(map(tuple, hex_density(cells, r).collect()))
        assert sum(x[2] for x in every[r]) == sum(p[2] for p in points)
