"""

Registered queries run over the whole ``events`` table (through the
derived detections view) with a reporting period that covers all of it.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracklens import oracle as O  # noqa: E402
from tracklens.functions.casting import to_mph  # noqa: E402
from tracklens.functions.classes import type_total  # noqa: E402
from tracklens.functions.timefn import epoch_us  # noqa: E402
from tracklens.operators import directions as D  # noqa: E402
from tracklens.operators import projections as P  # noqa: E402
from tracklens.operators import summary as S  # noqa: E402
from tracklens.operators import tracks as TR  # noqa: E402
from tracklens.operators import zonestats as Z  # noqa: E402
from tracklens.operators.filters import period_filter  # noqa: E402
from tracklens.operators.heatmap import center_latitude, heatmap, top_cells, unplaced_detections  # noqa: E402
from tracklens.operators import cellstates as CS  # noqa: E402
from tracklens.operators import segments as SG  # noqa: E402
from tracklens.operators.asof import asof_join  # noqa: E402
from tracklens.operators.quantiles import exact_quantiles  # noqa: E402
from tracklens.operators.rollup import track_rollup, track_zones  # noqa: E402
from tracklens.operators.speed import speed_profile  # noqa: E402
from tracklens.operators.timeline import timeline  # noqa: E402
from tracklens.params import Period, ThinParams  # noqa: E402
from tracklens.plans import periods as PP  # noqa: E402
from tracklens.plans import report as RP  # noqa: E402
from tracklens.plans import rollups as RU  # noqa: E402
from tracklens.plans import sinks as SK  # noqa: E402
from tracklens.plans.search import SearchIndex  # noqa: E402
from tracklens.session import scratch_dir  # noqa: E402
from tracklens.sources.features import as_features, feature_bounds, features_table, observed_zone_features  # noqa: E402
from tracklens.sources.orgs import ORG_DISPLAY_NAMES, org_registry, with_org_name  # noqa: E402
from tracklens.sources.detections import normalise, store_tenant, tenant_detections  # noqa: E402
from tracklens.sources.events_view import detections_from_events  # noqa: E402

try:  # the training-data operators may be left out of an installation
    import corpus_pipeline as PIPELINE
    from tracklens.llm import queries as LLM
except ImportError as missing:
    if (missing.name or "").split(".")[:2] not in (["corpus_pipeline"], ["tracklens", "llm"]):
        raise  # they are there, but something they need is not
    PIPELINE = LLM = None

SMOKE_DIR = "/root/testdata/sf0.001"
# whole data range of the test tables (every event falls inside)
REPORT = Period("2024-01-01T00:00:00", "2024-01-31T23:59:59")
# one week, to exercise the period predicate itself
WEEK = Period("2024-01-08T00:00:00", "2024-01-14T23:59:59")
TOP_CELLS = 25
# map heatmap: coarser cells and a two-track minimum, so the rounding and
# the minimum-tracks filter are exercised (the defaults equal `heatmap`'s)
MAP_PRECISION, MAP_MIN_POINTS = 4, 2
# the map's own cells: all of them
CELL_MIN_POINTS = 1
# thinning suited to the test data's sparse points (defaults suit 10 Hz sensors)
THIN = ThinParams(interval_ms=21_600_000, min_distance_m=25)
FIRST_TRACKS = 40  # the top-k of `first_tracks`
AT_MS = 864_000_000  # a playback instant in the middle of the data
TRAIL_AT_MS = 86_400_000  # a trail that holds points of the sparse test data
HEAD_STEP_MS = 3_600_000  # one playback frame per hour of data
TRAIL_STEP_MS, TRAIL_MS = 5_000, 180_000
HEX_RADIUS_M = 10
HEX_RADII_M = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50]  # the page's slider
HISTOGRAM_COLUMNS = 300  # a 900 px wide strip at 3 px per column
SEARCH = "dev-1 pedestrian"
ORG = "pip"


def _det(spark: SparkSession, sf_dir: str, period: Period = REPORT) -> DataFrame:
    return normalise(period_filter(detections_from_events(spark, sf_dir), period))


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return track_rollup(_det(spark, d))


def _map_tracks(spark: SparkSession, d: str) -> DataFrame:
    return TR.map_tracks(_det(spark, d), THIN)


def _map_bounds(spark: SparkSession, d: str) -> DataFrame:
    return TR.map_time_bounds(_det(spark, d), THIN)


def _t0(spark: SparkSession, d: str):
    return _map_bounds(spark, d).select("time_min_ms").scalar()


def _summary(spark: SparkSession, d: str) -> DataFrame:
    det = _det(spark, d)
    return RP.summary(track_rollup(det), track_zones(det), REPORT, ORG, spark)


def _map_cells(spark: SparkSession, d: str) -> DataFrame:
    return SK.heatmap_records(heatmap(_det(spark, d), MAP_PRECISION, CELL_MIN_POINTS))


def _hexagons(spark: SparkSession, d: str, choice: str) -> DataFrame:
    center = center_latitude(_det(spark, d), MAP_PRECISION)
    return RU.hex_density(RU.type_filter(_map_cells(spark, d), choice), HEX_RADIUS_M, center)


def _hexagons_of_radii(spark: SparkSession, d: str) -> DataFrame:
    center = center_latitude(_det(spark, d), MAP_PRECISION)
    return RU.hex_densities(_map_cells(spark, d), HEX_RADII_M, center)


def _of_tenants(det: DataFrame) -> DataFrame:
    """Detections with their tenant: every sensor is one's own."""
    device = F.col("device_identifier")
    return det.withColumn("org", F.when(device == "dev-0", "pip").otherwise(F.concat(F.lit("org-"), device)))


def _by_period(spark: SparkSession, d: str) -> PP.PeriodReports:
    """Results of all tenants, days and weeks."""
    det = _of_tenants(_det(spark, d))
    return PP.PeriodReports(det, SG.days_and_weeks(det), hold=False)


def _org_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Detections per tenant with the tenants' names."""
    per_org = _of_tenants(_det(spark, d)).groupBy("org").agg(F.count(F.lit(1)).alias("detections"))
    return with_org_name(per_org, "org", org_registry(spark))


def _stored_features(spark: SparkSession, d: str) -> DataFrame:
    """The derived feature table, registered under a name and read as a tenant's table is."""
    view = "geographic_features_of_test_org"
    _features(spark, d).createOrReplaceTempView(view)
    return RP.zone_features(features_table(spark, "test-org", view))


def _rose_records(spark: SparkSession, d: str) -> DataFrame:
    return SK.rose_records(D.direction_rose(_rollup(spark, d)))


def _zone_records(spark: SparkSession, d: str) -> DataFrame:
    return SK.zone_stats_records(Z.zone_stats(_det(spark, d)))


def _speed_records(spark: SparkSession, d: str) -> DataFrame:
    return SK.speed_profile_records(speed_profile(_det(spark, d)))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return observed_zone_features(_det(spark, d))


def _trip_trail(spark: SparkSession, d: str) -> DataFrame:
    span = _map_bounds(spark, d).select("time_range_ms").scalar()
    return TR.trip_trail(_map_tracks(spark, d), TRAIL_STEP_MS, TRAIL_MS, _t0(spark, d), span)


def _wkt_table(spark: SparkSession, d: str) -> DataFrame:
    """The derived feature table with its polygons as well-known text."""
    ring = F.regexp_extract("geometry", r"\[\[(.*)\]\]", 1)
    points = F.regexp_replace(F.regexp_replace(ring, r"\[([^,]+),([^\]]+)\]", "$1 $2"), ",", ", ")
    return as_features(_features(spark, d).withColumn("geometry", F.concat(F.lit("POLYGON (("), points, F.lit("))"))))


def _tenant_days(spark: SparkSession, d: str) -> DataFrame:
    """One tenant's timelines of a week's days, read from its catalog table by day."""
    run = uuid.uuid4().hex
    own = _of_tenants(detections_from_events(spark, d)).where(F.col("org") == ORG).drop("org")
    store_tenant(own, ORG, f"tenants_{run}", f"{scratch_dir(spark)}/tenant-{run}")
    first = WEEK.start_dt
    days = [(first + timedelta(i)).strftime("%Y-%m-%d") for i in range(7)]
    periods = SG.period_table(spark, [(ORG, Period(f"{x}T00:00:00", f"{x}T23:59:59")) for x in days])
    raw = SG.days_of(tenant_detections(spark, ORG, database=f"tenants_{run}"), periods, "date")
    return PP.PeriodReports(normalise(raw).withColumn("org", F.lit(ORG)), periods, hold=False).timeline()


def _raw_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    table = RU.raw_table(SK.heatmap_records(heatmap(_det(spark, d))))
    return SearchIndex.build(table, scratch_dir(spark)).search(SEARCH)


def _published_map_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A published report's map tracks, read back through its pointer with their declared schema."""
    root = f"{scratch_dir(spark)}/published-{uuid.uuid4().hex}"
    RP.build_report(spark, detections_from_events(spark, d), ORG, REPORT, root, THIN)
    return RP.read_report(spark, RP.snapshot_path(root, ORG, REPORT))["map-tracks"]


def _week_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The week's heatmap from stored daily states of the whole range."""
    path = f"{scratch_dir(spark)}/cell-states-{uuid.uuid4().hex}"
    CS.store_days(CS.daily_states(_det(spark, d)), path)
    return CS.heatmap_of_states(CS.stored_days(spark, path, WEEK.start_dt.date(), WEEK.end_dt.date()))


def _speed_box_exact(spark: SparkSession, d: str) -> DataFrame:
    """Box statistics of unrounded per-track speeds."""
    speeds = _det(spark, d).groupBy("track_identifier", type_total(F.col("object_type")).alias("object_type")).agg(
        to_mph(F.avg("speed_ms")).alias("mph")
    )
    q = exact_quantiles(speeds, "object_type", "mph", [0.25, 0.5, 0.75])
    return q.select("object_type", "min", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max", "count")


def _raw_speed_quantiles(spark: SparkSession, d: str) -> DataFrame:
    points = _det(spark, d).select("device_identifier", to_mph(F.col("speed_ms")).alias("mph"))
    return exact_quantiles(points, "device_identifier", "mph", [0.01, 0.5, 0.85, 0.99])


def _asof_leader(spark: SparkSession, d: str) -> DataFrame:
    """For every detection, where the track of the next number was last seen at that time."""
    det = _det(spark, d)
    us = epoch_us(F.col("timestamp"), True)
    number = F.substring("track_identifier", 5, 20).cast("long") + 1
    asked = det.select("event_id", "track_identifier", F.concat(F.lit("trk-"), number.cast("string")).alias("leader"), us.alias("asked_us"))
    seen = det.select(F.col("track_identifier").alias("leader"), us.alias("seen_us"), F.col("event_id").alias("tie"), "lon", "lat", "speed_ms")
    return asof_join(asked, seen, "leader", "asked_us", "seen_us", "tie", ["lon", "lat", "speed_ms"]).drop("asked_us")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the five-minute activity timeline on sf0.001."""
    return timeline(_det(spark, SMOKE_DIR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {**LLM.QUERIES, "pipeline": PIPELINE.run} if LLM else {}
    return more | {
        "timeline": lambda spark, d: timeline(_det(spark, d)),
        "period_filter": lambda spark, d: _det(spark, d, WEEK).select(
            "event_id", "track_identifier", "object_type", "device_identifier", "timestamp"
        ),
        "normalise": lambda spark, d: P.typed_points(_det(spark, d)),
        "type_case_total": lambda spark, d: P.type_classes(_det(spark, d), "total"),
        "type_map_partial": lambda spark, d: P.type_classes(_det(spark, d), "partial"),
        "compass8": lambda spark, d: P.heading_sectors(_det(spark, d)),
        "cardinal4": lambda spark, d: P.cardinal_sectors(_det(spark, d)),
        "zones_parsed": lambda spark, d: P.zones_parsed(_det(spark, d)),
        "zones_expanded": lambda spark, d: Z.zones_expanded(_det(spark, d)),
        "zone_stats": lambda spark, d: Z.zone_stats(_det(spark, d)),
        "track_zone_sets": lambda spark, d: Z.track_zone_sets(_det(spark, d)),
        "speed_profile": lambda spark, d: speed_profile(_det(spark, d)),
        "heatmap": lambda spark, d: heatmap(_det(spark, d)),
        "map_heatmap": lambda spark, d: heatmap(_det(spark, d), MAP_PRECISION, MAP_MIN_POINTS),
        "top_cells": lambda spark, d: top_cells(heatmap(_det(spark, d)), TOP_CELLS),
        "unplaced_detections": lambda spark, d: unplaced_detections(_det(spark, d)),
        "summary_totals": lambda spark, d: S.summary_totals(_rollup(spark, d)),
        "peak_hour": lambda spark, d: S.peak_hour(_rollup(spark, d)),
        "direction_counts": lambda spark, d: S.direction_counts(_rollup(spark, d)),
        "direction_4way": lambda spark, d: S.direction_4way(_rollup(spark, d)),
        "zones_active": lambda spark, d: S.zones_active(track_zones(_det(spark, d))),
        "zone_entry_tracks": lambda spark, d: S.zone_entry_tracks(track_zones(_det(spark, d))),
        "composition": lambda spark, d: S.composition(_rollup(spark, d)),
        "flow_rate": lambda spark, d: S.flow_rate(_rollup(spark, d), REPORT),
        "dominant_direction": lambda spark, d: D.dominant_direction(_rollup(spark, d)),
        "direction_rose": lambda spark, d: D.direction_rose(_rollup(spark, d)),
        "first_tracks": lambda spark, d: TR.first_tracks(_det(spark, d), FIRST_TRACKS),
        "step_distance": lambda spark, d: TR.step_distance(_det(spark, d)),
        "map_tracks": _map_tracks,
        "track_time_range": _map_bounds,
        "trips": lambda spark, d: TR.trips(_map_tracks(spark, d), _t0(spark, d)),
        "trip_heads": lambda spark, d: TR.trip_heads(_map_tracks(spark, d), HEAD_STEP_MS, _t0(spark, d)),
        "trip_trail": _trip_trail,
        "timeline_by_type": lambda spark, d: RU.type_filter(timeline(_det(spark, d)), "Pedestrian"),
        "rose_bins": lambda spark, d: RU.rose_bins(_rose_records(spark, d), "All"),
        "zone_rollup": lambda spark, d: RU.zone_rollup(_zone_records(spark, d), "All"),
        "zone_labels": lambda spark, d: RU.zone_labels(Z.zone_stats(_det(spark, d))),
        "heatmap_json_records": lambda spark, d: SK.heatmap_records(heatmap(_det(spark, d))),
        "timeline_records": lambda spark, d: SK.timeline_records(timeline(_det(spark, d))),
        "map_track_records": lambda spark, d: SK.map_track_records(_map_tracks(spark, d)),
        "raw_heatmap_table": lambda spark, d: RU.raw_table(SK.heatmap_records(heatmap(_det(spark, d)))),
        "raw_search": lambda spark, d: RU.raw_search(
            RU.raw_table(SK.heatmap_records(heatmap(_det(spark, d)))), SEARCH
        ),
        "speed_box_stats": lambda spark, d: RU.speed_box_stats(_speed_records(spark, d)),
        "speed_whiskers": lambda spark, d: RU.speed_whiskers(_speed_records(spark, d)),
        "bounds": lambda spark, d: RU.bounds(_map_cells(spark, d)),
        "hex_density": lambda spark, d: _hexagons(spark, d, "All"),
        "hex_density_by_type": lambda spark, d: _hexagons(spark, d, "Vehicle"),
        "trips_by_type": lambda spark, d: TR.trips(RU.type_filter(_map_tracks(spark, d), "Pedestrian"), _t0(spark, d)),
        "heads_at": lambda spark, d: TR.heads_at(_map_tracks(spark, d), AT_MS, _t0(spark, d)),
        "trail_at": lambda spark, d: TR.trail_at(_map_tracks(spark, d), AT_MS, TRAIL_AT_MS, _t0(spark, d)),
        "raw_speed_table": lambda spark, d: RU.raw_table(_speed_records(spark, d), "Speed Profile"),
        "speed_outliers": lambda spark, d: RU.speed_outliers(_speed_records(spark, d)),
        "org_lookup": _org_lookup,
        "stored_features": _stored_features,
        "exact_rounding": lambda spark, d: P.exact_rounding(_det(spark, d)),
        "histogram_columns": lambda spark, d: RU.histogram_columns(
            timeline(_det(spark, d)), _map_bounds(spark, d), HISTOGRAM_COLUMNS
        ),
        "zone_features": lambda spark, d: RP.zone_features(_features(spark, d)),
        "feature_type_counts": lambda spark, d: RP.feature_type_counts(_features(spark, d)),
        "period_slug": lambda spark, d: RP.daily_periods(_det(spark, d)),
        "org_names": lambda spark, d: RP.report_index(_det(spark, d), ORG),
        "summary": _summary,
        "hex_density_radii": _hexagons_of_radii,
        "wkt_features": lambda spark, d: RP.zone_features(_wkt_table(spark, d)),
        "feature_bounds": lambda spark, d: feature_bounds(_wkt_table(spark, d)),
        "tenant_days": _tenant_days,
        "raw_search_indexed": _raw_search_indexed,
        "published_map_tracks": _published_map_tracks,
        "heatmap_from_days": _week_from_days,
        "speed_box_exact": _speed_box_exact,
        "raw_speed_quantiles": _raw_speed_quantiles,
        "asof_leader": _asof_leader,
        "summary_by_period": lambda spark, d: _by_period(spark, d).summary(),
        "timeline_by_period": lambda spark, d: _by_period(spark, d).timeline(),
        "speed_profile_by_period": lambda spark, d: _by_period(spark, d).speed_profile(),
        "zone_stats_by_period": lambda spark, d: _by_period(spark, d).zone_stats(),
        "summary_by_filter": lambda spark, d: RU.summary_by_filter(_summary(spark, d), REPORT),
    }


def oracle_sql() -> dict[str, str]:
    s, e = REPORT.start, REPORT.end
    thin = (THIN.max_tracks, THIN.interval_ms, THIN.min_distance_m)
    cells = (MAP_PRECISION, CELL_MIN_POINTS)
    summ = (s, e, REPORT.hours(), REPORT.browser_hours(), ORG, ORG_DISPLAY_NAMES.get(ORG))
    more = LLM.oracle_sql() if LLM else {}
    return more | {
        "timeline": O.timeline(s, e),
        "period_filter": O.period_filter(WEEK.start, WEEK.end),
        "normalise": O.normalise(s, e),
        "type_case_total": O.type_case_total(s, e),
        "type_map_partial": O.type_map_partial(s, e),
        "compass8": O.compass8(s, e),
        "cardinal4": O.cardinal4(s, e),
        "zones_parsed": O.zones_parsed(s, e),
        "zones_expanded": O.zones_expanded(s, e),
        "zone_stats": O.zone_stats(s, e),
        "track_zone_sets": O.track_zone_sets(s, e),
        "speed_profile": O.speed_profile(s, e),
        "heatmap": O.heatmap(s, e),
        "map_heatmap": O.heatmap(s, e, MAP_PRECISION, MAP_MIN_POINTS),
        "top_cells": O.top_cells(s, e, TOP_CELLS),
        "unplaced_detections": O.unplaced_detections(s, e),
        "summary_totals": O.summary_totals(s, e),
        "peak_hour": O.peak_hour(s, e),
        "direction_counts": O.direction_counts(s, e),
        "direction_4way": O.direction_4way(s, e),
        "zones_active": O.zones_active(s, e),
        "zone_entry_tracks": O.zone_entry_tracks(s, e),
        "composition": O.composition(s, e),
        "flow_rate": O.flow_rate(s, e, REPORT.hours()),
        "dominant_direction": O.dominant_direction(s, e),
        "direction_rose": O.direction_rose(s, e),
        "first_tracks": O.first_tracks(s, e, FIRST_TRACKS),
        "step_distance": O.step_distance(s, e),
        "map_tracks": O.map_tracks(s, e, *thin),
        "track_time_range": O.track_time_range(s, e, *thin),
        "trips": O.trips(s, e, *thin),
        "trip_heads": O.trip_heads(s, e, *thin, HEAD_STEP_MS),
        "trip_trail": O.trip_trail(s, e, *thin, TRAIL_STEP_MS, TRAIL_MS),
        "timeline_by_type": O.timeline_by_type(s, e, "pedestrian"),
        "rose_bins": O.rose_bins(s, e),
        "zone_rollup": O.zone_rollup(s, e),
        "zone_labels": O.zone_labels(s, e),
        "heatmap_json_records": O.heatmap_json_records(s, e),
        "timeline_records": O.timeline_records(s, e),
        "map_track_records": O.map_track_records(s, e, *thin),
        "raw_heatmap_table": O.raw_heatmap_table(s, e),
        "raw_search": O.raw_search(s, e, SEARCH),
        "speed_box_stats": O.speed_box_stats(s, e),
        "speed_whiskers": O.speed_whiskers(s, e),
        "bounds": O.bounds(s, e, *cells),
        "hex_density": O.hex_density(s, e, *cells, HEX_RADIUS_M),
        "hex_density_by_type": O.hex_density_by_type(s, e, *cells, HEX_RADIUS_M, "vehicle"),
        "trips_by_type": O.trips_by_type(s, e, *thin, "pedestrian"),
        "heads_at": O.heads_at(s, e, *thin, AT_MS),
        "trail_at": O.trail_at(s, e, *thin, AT_MS, TRAIL_AT_MS),
        "raw_speed_table": O.raw_speed_table(s, e),
        "speed_outliers": O.speed_outliers(s, e),
        "org_lookup": O.org_lookup(s, e, ORG_DISPLAY_NAMES),
        "stored_features": O.zone_features(s, e),
        "exact_rounding": O.exact_rounding(s, e),
        "histogram_columns": O.histogram_columns(s, e, *thin, HISTOGRAM_COLUMNS),
        "zone_features": O.zone_features(s, e),
        "feature_type_counts": O.feature_type_counts(s, e),
        "period_slug": O.period_slug(s, e),
        "org_names": O.org_names(s, e, ORG, ORG_DISPLAY_NAMES.get(ORG)),
        "summary": O.summary_flat(*summ),
        "hex_density_radii": O.hex_density_radii(s, e, *cells, HEX_RADII_M),
        "wkt_features": O.zone_features(s, e),
        "feature_bounds": O.feature_bounds(s, e),
        "tenant_days": O.tenant_days(s, e, WEEK.start, WEEK.end),
        "raw_search_indexed": O.raw_search(s, e, SEARCH),
        "published_map_tracks": O.map_track_records(s, e, *thin),
        "heatmap_from_days": O.heatmap(WEEK.start, WEEK.end),
        "speed_box_exact": O.speed_box_exact(s, e),
        "raw_speed_quantiles": O.raw_speed_quantiles(s, e),
        "asof_leader": O.asof_leader(s, e),
        "summary_by_period": O.summary_by_period(s, e, ORG_DISPLAY_NAMES),
        "timeline_by_period": O.timeline_by_period(s, e),
        "speed_profile_by_period": O.speed_profile_by_period(s, e),
        "zone_stats_by_period": O.zone_stats_by_period(s, e),
        "summary_by_filter": O.summary_by_filter(*summ),
    }
