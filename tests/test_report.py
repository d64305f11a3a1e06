"""Report build, sinks, sources and negative cases."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from tracklens.params import Period, ThinParams, validate_slug
from tracklens.functions.timefn import epoch_us, from_epoch_us
from tracklens.operators.filters import period_filter
from tracklens.plans.rollups import rose_bins, speed_box_stats, zone_rollup
from tracklens.plans.report import (
    build_report,
    feature_collection,
    feature_lines,
    is_published,
    read_report,
    feature_type_counts,
    read_result,
    snapshot_path,
    zone_features,
)
from tracklens.sources.detections import table_name, tenant_detections
from tracklens.sources.events_view import detections_from_events
from tracklens.sources.features import FEATURES_SCHEMA, as_features, features_table, observed_zone_features
from tracklens.sources.detections import normalise
from tracklens.sources.orgs import org_registry, with_org_name

WEEK = Period("2024-01-08T00:00:00", "2024-01-14T23:59:59")

TIMELINE_SCHEMA = T.StructType(
    [T.StructField("bin_start", T.StringType()), T.StructField("object_type", T.StringType()),
     T.StructField("count", T.LongType())]
)


def test_build_report_round_trip_and_immutability(spark):
    out = tempfile.mkdtemp(prefix="tracklens-report-")
    raw = detections_from_events(spark, SF_SMALL)
    paths = build_report(spark, raw, "pip", WEEK, out, ThinParams(20, 3_600_000, 10))
    assert set(paths) == {"summary", "timeline", "speed-profile", "zone-stats", "direction-rose",
                          "heatmap", "map-heatmap", "map-tracks", "zones"}
    zones = json.loads("".join(r.value for r in spark.read.text(paths["zones"]).collect()))
    assert zones == {"type": "FeatureCollection", "features": []}  # no feature table for this tenant
    assert paths["timeline"].startswith(snapshot_path(out, "pip", WEEK))
    tl = read_result(spark, paths["timeline"], TIMELINE_SCHEMA)
    rows = tl.collect()
    assert sum(r["count"] for r in rows) == raw.where(
        "timestamp BETWEEN '2024-01-08 00:00:00' AND '2024-01-14 23:59:59'").count()
    assert all(r.bin_start.endswith("+00:00") and "T" in r.bin_start for r in rows)
    summ = spark.read.json(paths["summary"]).collect()[0]
    assert summ.org_name == "Portsmouth International Port"
    assert set(summ.directions.asDict()) == {"N", "NE", "E", "SE", "S", "SW", "W", "NW"}
    assert summ.period.start == WEEK.start
    # every published result reads back with its declared schema, nothing lost
    from tracklens.plans.sinks import result_schemas

    for name, schema in result_schemas().items():
        if name == "zones":
            continue
        back = read_result(spark, paths[name], schema)
        as_text = spark.read.json(paths[name])
        assert back.count() == as_text.count() > 0, name
        assert set(as_text.columns) <= set(schema.fieldNames()), name
    with pytest.raises(FileExistsError):
        build_report(spark, raw, "pip", WEEK, out)
    # nothing is left behind, neither half-built folders nor staged tables
    assert os.listdir(os.path.join(out, "org=pip")) == [f"period={WEEK.slug()}"]
    # the page's roll-ups run over the loaded results
    loaded = read_report(spark, snapshot_path(out, "pip", WEEK))
    assert set(loaded) == set(paths)
    assert rose_bins(loaded["direction-rose"]).count() == 8
    assert zone_rollup(loaded["zone-stats"]).count() > 0
    assert speed_box_stats(loaded["speed-profile"]).count() == 2
    assert loaded["summary"].first().directions_4way["all"].keys() == {"North", "South", "East", "West"}


def test_interrupted_build_leaves_nothing_published(spark, tmp_path, monkeypatch):
    from tracklens.plans import report

    raw, out = detections_from_events(spark, SF_SMALL), str(tmp_path)
    base = snapshot_path(out, "pip", WEEK)

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(report.sinks, "map_track_records", broken)
        with pytest.raises(RuntimeError):
            build_report(spark, raw, "pip", WEEK, out)
    assert not is_published(spark, base)
    with pytest.raises(FileNotFoundError):
        read_report(spark, base)
    os.makedirs(base)  # what another writer may have left
    paths = build_report(spark, raw, "pip", WEEK, out, ThinParams(7), map_precision=3, map_min_points=2)
    assert is_published(spark, base)
    version = report.current_version(spark, base)
    assert all(p.startswith(version) for p in paths.values())
    assert sorted(os.listdir(base)) == sorted([".CURRENT.crc", "CURRENT", os.path.basename(version)])
    manifest = json.loads(spark.read.text(f"{version}/_manifest").first()[0])
    assert manifest["max_tracks"] == 7 and manifest["tracks_left_out"] > 0
    assert spark.read.json(paths["map-heatmap"]).count() < spark.read.json(paths["heatmap"]).count()


def test_a_pointer_that_is_not_whole_publishes_nothing(spark, tmp_path):
    from tracklens.plans.report import current_version

    base = snapshot_path(str(tmp_path), "pip", WEEK)
    os.makedirs(base)
    for text in ("", "v-12"):
        with open(os.path.join(base, "CURRENT"), "w") as f:
            f.write(text)
        assert current_version(spark, base) is None and not is_published(spark, base)


def test_results_are_published_in_order(spark, tmp_path):
    paths = build_report(spark, detections_from_events(spark, SF_SMALL), "pip", WEEK, str(tmp_path), fmt="json")
    rows = {n: [json.loads(r.value) for r in spark.read.text(paths[n]).collect()] for n in ("timeline", "speed-profile", "map-tracks", "heatmap")}
    keys = {
        "timeline": lambda r: (r["bin_start"], r["object_type"]),
        "speed-profile": lambda r: (-r["avg_speed"], r["track_id"]),
        "map-tracks": lambda r: (r["track_id"], r["timestamp"]),
        "heatmap": lambda r: -r["point_count"],
    }
    for name, key in keys.items():
        assert rows[name] and rows[name] == sorted(rows[name], key=key), name


def test_zoned_timestamps_give_the_same_report_in_any_session(spark):
    from tracklens.operators.rollup import track_rollup, track_zones
    from tracklens.operators.timeline import timeline
    from tracklens.plans.report import daily_periods, summary
    from tracklens.plans.sinks import timeline_records

    raw = detections_from_events(spark, SF_SMALL)
    zoned = raw.withColumn("timestamp", from_epoch_us(epoch_us(F.col("timestamp"), True), False))
    assert dict(zoned.dtypes)["timestamp"] == "timestamp"

    def results(source):
        det = normalise(period_filter(source, WEEK))
        frames = summary(track_rollup(det), track_zones(det), WEEK, "pip"), timeline_records(timeline(det)), daily_periods(det)
        return [sorted(map(tuple, f.collect()), key=repr) for f in frames]

    want = results(raw)
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert results(zoned) == want
            assert results(raw) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_period_and_columns_reach_the_scan(spark):
    from tracklens.operators.timeline import timeline

    df = timeline(normalise(period_filter(detections_from_events(spark, SF_SMALL), WEEK)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "GreaterThanOrEqual(ts," in scan and "LessThanOrEqual(ts," in scan
    assert scan.endswith("ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>")
    assert "InMemoryRelation" not in plan


def test_shared_folder_is_required(spark):
    from tracklens.session import checkpoint_dir

    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        checkpoint_dir(Unset)


def test_hyphenated_tenant(spark):
    detections_from_events(spark, SF_SMALL).createOrReplaceTempView("`my-org`")
    try:
        assert tenant_detections(spark, "my-org").count() == 1000
    finally:
        spark.catalog.dropTempView("`my-org`")
    assert features_table(spark, "my-org").count() == 0


def test_features_as_stored(spark):
    import struct

    def ring(order, *points):
        return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)

    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    polygon = b"\x01" + struct.pack("<II", 3, 1) + ring("<", *square)
    point = b"\x00" + struct.pack(">I", 1) + struct.pack(">2d", -1.5, 50.25)
    both = b"\x01" + struct.pack("<II", 7, 2) + point + polygon
    rows = [
        ("a", "A", "zone", bytearray(polygon), {"gate": "A"}),
        ("b", "B", "subzone", bytearray(point), None),
        ("c", "C", "zone", bytearray(both), {}),
        ("d", "D", "zone", bytearray(b"\x01junk"), None),
        ("e", "E", "zone", None, None),
    ]
    kinds = "feature_id string, feature_name string, feature_type string, geometry binary, metadata map<string,string>"
    got = {r.feature_id: r for r in as_features(spark.createDataFrame(rows, kinds)).collect()}
    assert json.loads(got["a"].geometry) == {"type": "Polygon", "coordinates": [[list(p) for p in square]]}
    assert json.loads(got["b"].geometry) == {"type": "Point", "coordinates": [-1.5, 50.25]}
    assert [g["type"] for g in json.loads(got["c"].geometry)["geometries"]] == ["Point", "Polygon"]
    assert got["d"].geometry is None and got["e"].geometry is None
    assert json.loads(got["a"].metadata) == {"gate": "A"}
    doc = json.loads("".join(r.value for r in feature_lines(as_features(spark.createDataFrame(rows, kinds))).collect()))
    assert [f["properties"]["feature_id"] for f in doc["features"]] == ["a", "b", "c"]
    assert doc["features"][0]["properties"]["metadata"] == {"gate": "A"}

    text = "feature_id string, feature_name string, feature_type string, geometry string, metadata struct<n:int>"
    rows = [("x", "X", "zone", '{"type":"Point","coordinates":[1,2]}', (3,)), ("y", "Y", "zone", "POINT(1 2)", None), ("w", "W", "zone", "POINT(1", None)]
    got = {r.feature_id: r for r in as_features(spark.createDataFrame(rows, text)).collect()}
    assert json.loads(got["x"].metadata) == {"n": 3} and got["w"].geometry is None
    assert got["y"].geometry == got["x"].geometry
    broken = spark.createDataFrame([("z", "Z", "zone", '{"type":"Point","coordinates":[1,2]}', "{broken")], FEATURES_SCHEMA)
    assert json.loads(feature_collection(broken).first()[0])["features"][0]["properties"]["metadata"] == {}


def test_slug_validation():
    assert validate_slug("pip") == "pip"
    assert table_name("pip") == "fif" and table_name("tfl") == "tfl"
    for bad in ["", "Pip", "1abc", "a" * 64, "a.b", "a;drop"]:
        with pytest.raises(ValueError):
            validate_slug(bad)


def test_tenant_scan_from_parquet_root(spark):
    root = tempfile.mkdtemp(prefix="tracklens-tenants-")
    detections_from_events(spark, SF_SMALL).write.parquet(os.path.join(root, "fif"))
    df = tenant_detections(spark, "pip", root=root)
    assert df.count() == 1000


def test_missing_features_table_is_empty(spark):
    df = features_table(spark, "nosuchorg")
    assert df.count() == 0 and df.schema == FEATURES_SCHEMA
    fc = json.loads(feature_collection(df).collect()[0].geojson)
    assert fc == {"type": "FeatureCollection", "features": []}


def test_feature_collection(spark):
    rows = [
        ("z1", "freight_yard", "zone", '{"type":"Point","coordinates":[1,2]}', '{"gate":"A"}'),
        ("z2", "no_geom", "zone", None, None),
        ("s1", "yard_a", "subzone", '{"type":"Point","coordinates":[3,4]}', None),
    ]
    df = spark.createDataFrame(rows, FEATURES_SCHEMA)
    fc = json.loads(feature_collection(df).collect()[0].geojson)
    assert [f["properties"]["feature_id"] for f in fc["features"]] == ["s1", "z1"]
    assert fc["features"][0]["properties"]["metadata"] == {}
    assert fc["features"][1]["properties"]["metadata"] == {"gate": "A"}
    assert fc["features"][1]["geometry"]["coordinates"] == [1, 2]
    counts = {r.feature_type: r.features for r in feature_type_counts(df).collect()}
    assert counts == {"zone": 1, "subzone": 1}
    assert zone_features(df).count() == 2


def test_observed_features_have_valid_geojson(spark):
    det = normalise(detections_from_events(spark, SF_SMALL))
    feats = zone_features(observed_zone_features(det)).collect()
    assert feats
    for f in feats:
        g = json.loads(f.geometry)
        ring = g["coordinates"][0]
        assert g["type"] == "Polygon" and ring[0] == ring[-1] and len(ring) == 5
        json.loads(f.metadata)


def test_org_lookup_falls_back_to_slug(spark):
    df = spark.createDataFrame([("pip",), ("tfl",)], "slug string")
    got = {r.slug: r.org_name for r in with_org_name(df, "slug", org_registry(spark)).collect()}
    assert got == {"pip": "Portsmouth International Port", "tfl": "tfl"}


def test_date_partition_pruning(spark):
    from tracklens.operators.filters import period_filter

    root = os.path.join(tempfile.mkdtemp(prefix="tracklens-part-"), "detections")
    raw = detections_from_events(spark, SF_SMALL).selectExpr("*", "to_date(timestamp) AS event_date")
    raw.write.partitionBy("event_date").parquet(root)
    f = period_filter(spark.read.parquet(root), WEEK, date_col="event_date")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    n = f.count()
    assert n == raw.where("timestamp BETWEEN '2024-01-08 00:00:00' AND '2024-01-14 23:59:59'").count()


def test_cli_builds_a_report(spark, monkeypatch):
    from tracklens import cli

    src = tempfile.mkdtemp(prefix="tracklens-cli-src-")
    detections_from_events(spark, SF_SMALL).write.parquet(os.path.join(src, "acme"))
    out = tempfile.mkdtemp(prefix="tracklens-cli-out-")
    monkeypatch.setenv("PERIOD_START", "2024-01-08T00:00:00")
    monkeypatch.setenv("PERIOD_END", "2024-01-08T23:59:59")
    paths = cli.main(
        ["--org_subdomain", "acme", "--source", src, "--out", out, "--thin-interval-ms", "60000"], spark=spark
    )
    assert "/org=acme/period=2024-01-08_to_2024-01-08/v-" in paths["summary"] and paths["summary"].endswith("/summary")
    summ = spark.read.json(paths["summary"]).collect()[0]
    assert summ.org_name == "acme" and summ.period.start == "2024-01-08T00:00:00"
    with pytest.raises(SystemExit):
        cli.main(["--org_subdomain", "acme", "--out", out], spark=spark)
    with pytest.raises(ValueError):
        cli.main(["--org_subdomain", "Bad!", "--source", src, "--out", out], spark=spark)


def test_tenant_scan_from_catalog(spark):
    detections_from_events(spark, SF_SMALL).createOrReplaceTempView("acme")
    try:
        assert tenant_detections(spark, "acme").count() == 1000
    finally:
        spark.catalog.dropTempView("acme")
