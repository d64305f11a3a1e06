"""Trajectory operators: thinning rules (T8), chunked sequence windows, heads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, det_df, raw_df
from tracklens.operators.filters import period_filter
from tracklens.operators.tracks import (
    _segments,
    first_tracks,
    heads_at,
    left_out,
    map_tracks,
    step_distance,
    thinned_points,
    trail_at,
    trip_heads,
    trip_trail,
    trips,
)
from tracklens.params import Period, ThinParams
from tracklens.sources.detections import normalise
from tracklens.sources.events_view import detections_from_events

ALL = Period("2024-01-01T00:00:00", "2024-01-31T23:59:59")
# 1e-5 degrees of latitude is about 1.1 m
STEP = 0.00001


def _pt(track, t, lat, lon="-1.0", typ="small", **kw):
    return dict(track_identifier=track, object_type=typ, device_identifier="dev-0",
                timestamp=f"2024-01-08T{t}", longitude=lon, latitude=f"{lat:.6f}" if isinstance(lat, float) else lat,
                speed="1", heading_degrees="0", **kw)


def _kept(spark, rows, thin):
    det = det_df(spark, rows)
    return sorted((r.track_identifier, str(r.timestamp)) for r in thinned_points(det, thin).collect())


def test_slow_mover_keeps_first_and_last(spark):
    # steps of ~0.55 m, 10 s apart: every point starts a 1 s bucket but is too close
    rows = [_pt("slow", f"10:00:{10 * i:02d}", 50.8 + i * STEP / 2) for i in range(6)]
    kept = _kept(spark, rows, ThinParams(max_tracks=10, interval_ms=1000, min_distance_m=1))
    assert kept == [("slow", "2024-01-08 10:00:00"), ("slow", "2024-01-08 10:00:50")]
    # min distance 0 keeps the first point of every bucket
    assert len(_kept(spark, rows, ThinParams(10, 1000, 0))) == 6


def test_buckets_and_equal_last_timestamps(spark):
    rows = [
        _pt("t", "10:00:00.000", 50.80),
        _pt("t", "10:00:00.040", 50.81),  # same 100 ms bucket -> dropped
        _pt("t", "10:00:00.150", 50.82),  # next bucket, far enough -> kept
        _pt("t", "10:00:01.000", 50.83),
        _pt("t", "10:00:01.000", 50.83),  # two rows at the last timestamp: both kept
    ]
    kept = _kept(spark, rows, ThinParams(10, 100, 1))
    assert [k[1].split(" ")[1] for k in kept] == ["10:00:00", "10:00:00.150000", "10:00:01", "10:00:01"]
    # interval 0: one bucket per millisecond, so the 40 ms point is kept too
    assert len(_kept(spark, rows, ThinParams(10, 0, 1))) == 5


def test_missing_coordinates(spark):
    rows = [
        _pt("t", "10:00:00", 50.80),
        _pt("t", "10:00:10", 50.81, lon="bad"),  # current lon NULL -> distance NULL -> dropped
        _pt("t", "10:00:20", 50.80),  # previous lon NULL -> "no previous" -> kept
        _pt("t", "10:00:30", 50.80),  # 0 m -> dropped
        _pt("t", "10:00:40", 50.80),  # last -> kept
    ]
    kept = _kept(spark, rows, ThinParams(10, 1000, 1))
    assert [k[1].split(" ")[1] for k in kept] == ["10:00:00", "10:00:20", "10:00:40"]


def test_track_cap_ties_by_track_id(spark):
    rows = [_pt(t, "10:00:00", 50.8) for t in ["c", "b", "a"]] + [_pt("z", "09:00:00", 50.8)]
    sel = [r.track_identifier for r in first_tracks(det_df(spark, rows), 2).collect()]
    assert sel == ["z", "a"]


@pytest.fixture(scope="module")
def small_det(spark):
    return period_filter(normalise(detections_from_events(spark, SF_SMALL)), ALL)


def test_chunk_size_does_not_change_results(spark, small_det):
    base = ThinParams(20, 3_600_000, 10, chunk_ms=10**13)
    for chunk in (3_600_000, 86_400_000):
        other = ThinParams(20, 3_600_000, 10, chunk_ms=chunk)
        a = thinned_points(small_det, base).select("event_id").collect()
        b = thinned_points(small_det, other).select("event_id").collect()
        assert sorted(a) == sorted(b)
    d1 = step_distance(small_det, chunk_ms=10**13).collect()
    d2 = step_distance(small_det, chunk_ms=600_000).collect()
    assert sorted(d1) == sorted(d2)


def test_kept_points_are_a_subset_with_ends(spark, small_det):
    thin = ThinParams(10, 7_200_000, 25)
    pts = map_tracks(small_det, thin)
    kept = pts.groupBy("track_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    raw = small_det.groupBy("track_identifier").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    k = {r.track_id: (r.a, r.b) for r in kept.collect()}
    r = {x.track_identifier: (x.a, x.b) for x in raw.collect()}
    assert len(k) == 10
    for t, ends in k.items():
        assert ends == r[t]
    ids = {x.event_id for x in pts.select("event_id").collect()}
    assert ids <= {x.event_id for x in small_det.select("event_id").collect()}


def _three_point_track(spark):
    rows = [
        dict(_pt("t", "10:00:00", 50.0, lon="0.0"), speed="0"),
        dict(_pt("t", "10:00:10", 50.0, lon="1.0"), speed="10"),
        dict(_pt("t", "10:00:20", 51.0, lon="1.0"), speed="0"),
    ]
    return map_tracks(det_df(spark, rows), ThinParams(10, 0, 0))


def test_trip_heads(spark):
    pts = _three_point_track(spark)
    heads = {r.frame_ms: r for r in trip_heads(pts, step_ms=5000).collect()}
    assert sorted(heads) == [0, 5000, 10000, 15000, 20000]
    assert (heads[0].lon, heads[0].lat) == (0.0, 50.0)  # latitude 0 -> 0 rule does not apply
    assert heads[5000].lon == pytest.approx(0.5)
    assert heads[5000].speed == pytest.approx(round(10 * 2.23694, 1) / 2)
    assert (heads[10000].lon, heads[10000].lat) == (1.0, 50.0)
    assert heads[15000].lat == pytest.approx(50.5)
    assert heads[20000].lat == 51.0
    t = trips(pts).collect()[0]
    assert t.timestamps == [0, 10000, 20000] and t.coordinates[1] == [1.0, 50.0]


def test_trip_trail(spark):
    pts = _three_point_track(spark)
    trail = trip_trail(pts, step_ms=5000, trail_ms=10000).collect()
    frames = {}
    for r in trail:
        frames.setdefault(r.frame_ms, []).append(r.t)
    assert frames == {0: [0], 5000: [0], 10000: [0, 10000], 15000: [10000], 20000: [10000, 20000]}


def test_null_track_and_empty_key_cross_chunks(spark):
    rows = [
        _pt(None, "10:59:59", 50.80),
        _pt(None, "11:00:01", 50.81),
        _pt("", "10:59:58", 50.70),
        _pt("", "11:00:02", 50.71),
    ]
    det = det_df(spark, rows)
    a = {(r.track_identifier, str(r.timestamp)): r.distance_m for r in step_distance(det, chunk_ms=3_600_000).collect()}
    b = {(r.track_identifier, str(r.timestamp)): r.distance_m for r in step_distance(det, chunk_ms=10**13).collect()}
    assert a == b
    assert a[(None, "2024-01-08 11:00:01")] == pytest.approx(1112.0, rel=0.01)
    assert a[("", "2024-01-08 11:00:02")] == pytest.approx(1112.0, rel=0.01)


def test_no_cap_keeps_every_track(spark, small_det):
    free, capped = ThinParams(None, 3_600_000, 10), ThinParams(5, 3_600_000, 10)
    tracks = {r.track_id for r in map_tracks(small_det, free).select("track_id").distinct().collect()}
    assert tracks == {r[0] for r in small_det.select("track_identifier").distinct().collect()}
    few = {r.track_id for r in map_tracks(small_det, capped).select("track_id").distinct().collect()}
    assert len(few) == 5 and few < tracks
    assert left_out(small_det, 5).first()[0] == len(tracks) - 5
    assert left_out(small_det, None).first()[0] == 0


def test_equal_times_have_one_order_without_event_ids(spark):
    rows = [dict(_pt("t", "10:00:00", 50.80 + i * 0.001, lon=f"-1.{i}")) for i in range(6)]
    rows += [_pt("t", "10:00:05", 50.9)]
    raw = raw_df(spark, rows).drop("event_id")
    once, again = (
        sorted((str(r.timestamp), r.lon, r.prev_lon) for r in thinned_points(normalise(d), ThinParams(None, 0, 0)).collect())
        for d in (raw, raw.orderBy(F.desc("longitude")))
    )
    assert once == again


def _plan_nodes(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_map_tracks_reads_the_source_twice_and_never_gathers_it(spark, tmp_path):
    path = str(tmp_path / "det")
    detections_from_events(spark, SF_SMALL).write.parquet(path)
    det = normalise(period_filter(spark.read.parquet(path), ALL))
    plan = _plan_nodes(map_tracks(det, ThinParams(None, 3_600_000, 10)))
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 2
    assert "SinglePartition" not in final
    origin = F.lit(0).cast("long")
    trip_plan = _plan_nodes(trips(map_tracks(det, ThinParams(None, 3_600_000, 10)), origin)).split("== Initial Plan ==")[0]
    assert "SinglePartition" not in trip_plan


def test_heads_and_trail_at_one_instant(spark):
    pts = _three_point_track(spark)
    by_frame = {r.frame_ms: r for r in trip_heads(pts, step_ms=5000).collect()}
    for at in (0, 5000, 10000, 15000, 20000):
        (head,) = heads_at(pts, at).collect()
        assert (head.lon, head.lat, head.speed) == (by_frame[at].lon, by_frame[at].lat, by_frame[at].speed)
    assert heads_at(pts, -1).collect() == [] and heads_at(pts, 20001).collect() == []
    assert sorted(r.t for r in trail_at(pts, 15000, 10000).collect()) == [10000]
    assert sorted(r.t for r in trail_at(pts, 20000, 20000).collect()) == [0, 10000, 20000]


def test_segments_do_not_depend_on_the_chunk(spark, small_det):
    pts = map_tracks(small_det, ThinParams(None, 3_600_000, 10))
    rows = [
        sorted(map(repr, _segments(pts, F.lit(0).cast("long"), chunk).collect())) for chunk in (600_000, 10**13)
    ]
    assert rows[0] == rows[1]


def test_rows_without_a_time_are_kept(spark):
    rows = [{"track_identifier": "a", "timestamp": t, "longitude": x, "latitude": "0"}
            for t, x in ((None, "0"), ("2024-01-01T00:00:00", "0.001"), (None, "0.002"), ("2024-01-01T05:00:00", "0.002"))]
    got = {r.event_id: r.distance_m for r in step_distance(det_df(spark, rows)).collect()}
    plain = {r.event_id: r.distance_m for r in step_distance(det_df(spark, rows), 10**12).collect()}
    assert set(got) == {0, 1, 2, 3} and got == plain
    assert got[0] == 0 and got[2] > 200 and got[1] > 100 and got[3] > 100
