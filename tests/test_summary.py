"""Summary family on hand-made detections (traps T1, T2, T3, T6, T9, T10)."""

from __future__ import annotations

import pytest

from conftest import det_df
from tracklens.operators import summary as S
from tracklens.operators.directions import direction_rose, dominant_direction
from tracklens.operators.filters import period_filter
from tracklens.operators.rollup import track_rollup, track_zones
from tracklens.params import Period
from tracklens.plans.report import summary

WEEK = Period("2024-01-08T00:00:00", "2024-01-14T23:59:59")


def _rows():
    d = "2024-01-08T"
    r = []

    def add(track, typ, t, heading=None, speed=None, zones=None):
        r.append(dict(track_identifier=track, object_type=typ, device_identifier="dev-0", timestamp=t,
                      longitude="-1.0", latitude="50.8", heading_degrees=heading, speed=speed, zones_hit=zones))

    # A: N/NE tie on 8-way (N wins), North/East tie on 4-way (East wins)
    add("trk-a", "small", d + "08:00:00", "10", "1", '["terminal_a","freight_yard"]')
    add("trk-a", "small", d + "08:10:00", "50", "2")
    add("trk-a", "small", d + "09:00:00", "55", "3")
    add("trk-a", "small", d + "09:30:00", "5", None)
    # B: both classes in one track
    add("trk-b", "small", d + "10:00:00", "100", "4")
    add("trk-b", "small", d + "10:05:00", "100", "4")
    add("trk-b", "large", d + "10:10:00", "200", "10")
    # C: raw 'large' West x3 + North x2, raw NULL North x2 (T6)
    for i, h in enumerate(["300", "300", "300", "0", "0"]):
        add("trk-c", "large", d + f"11:0{i}:00", h, "5" if i == 0 else None, "[broken" if i == 0 else None)
    add("trk-c", None, d + "11:05:00", "0")
    add("trk-c", None, d + "11:06:00", "0")
    # D: single point, no heading, bare zone with padding, unparseable speed
    add("trk-d", "small", d + "12:00:00", None, "n/a", " freight_yard ")
    # NULL track id
    add(None, "large", d + "13:00:00", "90", None, "freight_yard")
    add(None, "large", d + "13:01:00", "90")
    # period edges: exactly on the start is in, half a second after the end is out
    add("trk-g", "small", "2024-01-08T00:00:00")
    add("trk-f", "small", "2024-01-14T23:59:59.500000")
    return r


@pytest.fixture(scope="module")
def det(spark):
    return period_filter(det_df(spark, _rows()), WEEK)


@pytest.fixture(scope="module")
def flat(spark, det):
    return summary(track_rollup(det), track_zones(det), WEEK, "pip", spark).collect()[0]


def test_counts_and_speeds(flat):
    assert (flat.total_detections, flat.pedestrian_count, flat.vehicle_count) == (5, 4, 2)
    assert (flat.pedestrian_pct, flat.vehicle_pct) == (80, 40)
    assert flat.avg_speed == 9.3 and flat.top_speed == 22.4
    assert flat.ped_avg_speed == 6.3 and flat.ped_top_speed == 8.9
    assert flat.veh_avg_speed == 16.8 and flat.veh_top_speed == 22.4
    assert flat.flow_rate_per_hour == 0
    assert flat.org_name == "Portsmouth International Port"


def test_peak_hour_tie_goes_to_lowest_hour(flat):
    assert flat.peak_hour == "00:00"


def test_directions(flat):
    dirs = {d: flat[f"dir_{d}"] for d in ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]}
    assert dirs == {"N": 2, "NE": 0, "E": 2, "SE": 0, "S": 0, "SW": 0, "W": 0, "NW": 0}
    ped = {c: flat[f"dir4_pedestrian_{c}"] for c in ["North", "South", "East", "West"]}
    veh = {c: flat[f"dir4_vehicle_{c}"] for c in ["North", "South", "East", "West"]}
    assert ped == {"North": 0, "South": 0, "East": 2, "West": 0}
    # T6: trk-c takes its largest single raw-type row (large/West 3), not North 2+2
    assert veh == {"North": 0, "South": 1, "East": 1, "West": 1}
    assert flat.dir4_all_East == 3


def test_zones(flat):
    # terminal_a, freight_yard and the malformed text itself
    assert flat.zones_active == 3
    # trk-a, trk-d and the NULL track
    assert flat.freight_entries == 3


def test_rose_and_dominant(spark, det):
    roll = track_rollup(det)
    rose = {(r.direction, r.object_type): r for r in direction_rose(roll).collect()}
    assert set(rose) == {("N", "pedestrian"), ("E", "pedestrian"), ("S", "vehicle"), ("N", "vehicle")}
    # rose merges raw types first: trk-c is N (2 + 2) over NW (3)
    assert rose[("N", "vehicle")]["count"] == 1
    assert rose[("S", "vehicle")].avg_speed == pytest.approx(round(10 * 2.23694, 1))
    dom = {r.track_identifier: r.direction for r in dominant_direction(roll).collect()}
    assert dom == {"trk-a": "N", "trk-b": "E", "trk-c": "N", None: "E"}


def test_components_agree_with_summary(det, flat):
    roll = track_rollup(det)
    assert S.peak_hour(roll).collect()[0].peak_hour == flat.peak_hour
    assert {r.direction: r.tracks for r in S.direction_counts(roll).collect()}["N"] == flat.dir_N
    four = {(r.object_type, r.cardinal): r.tracks for r in S.direction_4way(roll).collect()}
    assert len(four) == 12 and four[("all", "East")] == 3
    assert S.zones_active(track_zones(det)).collect()[0][0] == 3


def test_empty_period(spark):
    det = period_filter(det_df(spark, _rows()), Period("2030-01-01T00:00:00", "2030-01-01T23:59:59"))
    f = summary(track_rollup(det), track_zones(det), WEEK, "acme", spark).collect()[0]
    assert f.total_detections == 0 and f.pedestrian_pct == 0 and f.avg_speed == 0.0
    assert f.peak_hour == "00:00" and f.zones_active == 0 and f.freight_entries == 0
    assert f.dir_N == 0 and f.dir4_all_North == 0
    assert f.org_name == "acme"


def test_period_hours_rules():
    assert Period("2024-01-08T00:00:00", "2024-01-08T00:30:00").hours() == 1
    assert Period("2024-01-08T00:00:00Z", "2024-01-09T00:00:00Z").hours() == 24
    assert Period("2024-01-08T00:00:00+00:00", "2024-01-10T00:00:00+00:00").hours() == 24
    assert Period("2024-01-08T00:00:00", "2024-01-10T00:00:00").hours() == 48
    assert Period("2024-01-08T00:00:00+00:00", "2024-01-10T00:00:00+00:00").browser_hours() == 48
    assert Period("2026-01-19T00:00:00", "2026-01-19T23:59:59").slug() == "2026-01-19_to_2026-01-19"


def test_summary_record_shape(spark, det):
    import json

    from pyspark.sql import functions as F

    from tracklens.plans.report import summary_record

    flat = summary(track_rollup(det), track_zones(det), WEEK, "pip", spark)
    doc = json.loads(summary_record(flat).select(F.to_json(F.struct("*")).alias("j")).collect()[0].j)
    assert set(doc) == {
        "total_detections", "pedestrian_count", "vehicle_count", "composition", "avg_speed", "top_speed",
        "ped_avg_speed", "ped_top_speed", "veh_avg_speed", "veh_top_speed", "flow_rate_per_hour",
        "freight_entries", "peak_hour", "zones_active", "directions", "directions_4way", "period",
        "org_subdomain", "org_name",
    }
    assert set(doc["composition"]) == {"pedestrian_pct", "vehicle_pct"}
    assert list(doc["directions"]) == ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    assert set(doc["directions_4way"]) == {"all", "pedestrian", "vehicle"}
    assert set(doc["directions_4way"]["all"]) == {"North", "South", "East", "West"}
    assert doc["period"] == {"start": WEEK.start, "end": WEEK.end}
