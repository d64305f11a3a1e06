"""Cross-result invariants on the smallest test tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracklens.functions.classes import type_total
from tracklens.operators.directions import direction_rose
from tracklens.operators.filters import period_filter
from tracklens.operators.rollup import track_rollup
from tracklens.operators.timeline import timeline
from tracklens.operators.tracks import map_tracks, trip_heads
from tracklens.operators.zonestats import zone_stats
from tracklens.params import Period, ThinParams
from tracklens.plans.rollups import zone_rollup
from tracklens.plans.sinks import zone_stats_records
from tracklens.sources.detections import normalise
from tracklens.sources.events_view import detections_from_events

ALL = Period("2024-01-01T00:00:00", "2024-01-31T23:59:59")


@pytest.fixture(scope="module")
def det(spark):
    return period_filter(normalise(detections_from_events(spark, SF_SMALL)), ALL)


def test_rose_counts_equal_tracks_with_heading(det):
    rose = {r.object_type: r.n for r in direction_rose(track_rollup(det)).groupBy("object_type")
            .agg(F.sum("count").alias("n")).collect()}
    want = {
        r.cls: r.n
        for r in det.where(F.col("heading_degrees").isNotNull() & F.col("track_identifier").isNotNull())
        .groupBy(type_total(F.col("object_type")).alias("cls"))
        .agg(F.count_distinct("track_identifier").alias("n"))
        .collect()
    }
    assert rose == want


def test_timeline_sums_to_points(det):
    assert timeline(det).agg(F.sum("count")).collect()[0][0] == det.count()


def test_zone_rollup_preserves_detections(det):
    zs = zone_stats_records(zone_stats(det))
    assert zone_rollup(zs).agg(F.sum("detections")).collect()[0][0] == zs.agg(F.sum("detections")).collect()[0][0]


def test_heads_lie_on_their_segments(det):
    pts = map_tracks(det, ThinParams(10, 3_600_000, 10))
    heads = trip_heads(pts, step_ms=600_000).collect()
    assert heads
    by_track = {}
    for r in pts.select("track_id", "longitude", "latitude").collect():
        by_track.setdefault(r.track_id, []).append((r.longitude, r.latitude))
    for h in heads:
        lons = [p[0] for p in by_track[h.trackId]]
        lats = [p[1] for p in by_track[h.trackId]]
        assert min(lons) - 1e-9 <= h.lon <= max(lons) + 1e-9
        assert min(lats) - 1e-9 <= h.lat <= max(lats) + 1e-9
