"""The summary record, zone features, snapshot paths and the report build."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_even
from tracklens.functions.compass import CARDINAL_LABELS, COMPASS_LABELS
from tracklens.operators import summary as S
from tracklens.operators.directions import direction_rose
from tracklens.operators.filters import period_filter
from tracklens.operators.heatmap import heatmap
from tracklens.operators.rollup import track_rollup, track_zones
from tracklens.operators.speed import speed_profile
from tracklens.operators.timeline import timeline
from tracklens.operators.tracks import left_out, map_tracks
from tracklens.operators.zonestats import zone_stats
from tracklens.params import DEFAULT_MIN_POINTS, DEFAULT_PRECISION, FREIGHT_ZONE, Period, ThinParams, validate_slug
from tracklens.plans import sinks
from tracklens.sources.detections import normalise
from tracklens.sources.features import features_table
from tracklens.session import remove_path, scratch_dir, stage_table, unstage
from tracklens.sources.orgs import org_name_literal

MANIFEST = "_manifest"
POINTER = "CURRENT"
SPEED_FIELDS = ["avg_speed", "top_speed", "ped_avg_speed", "ped_top_speed", "veh_avg_speed", "veh_top_speed"]


def summary(
    rollup: DataFrame,
    zones: DataFrame,
    period: Period,
    org: str,
    spark: SparkSession | None = None,
    zone: str = FREIGHT_ZONE,
) -> DataFrame:
    """One flat row with every summary KPI (NULL speeds reported as 0).

    Counts, speeds, peak hour and directions come from one aggregation
    over the per-track roll-up; the zone figures are scalar subqueries over
    the distinct (track, zone) table.
    """
    agg = rollup.agg(*summary_aggs()).select("*", S._best_hour().alias("_best"))
    zf = S.zone_figures(zones, zone).scalar()
    return agg.select(
        *summary_columns(F.lit(float(period.hours())), zf.getField("freight_entries"), zf.getField("zones_active")),
        F.lit(period.start).alias("period_start"),
        F.lit(period.end).alias("period_end"),
        F.lit(org).alias("org_subdomain"),
        # the org is a parameter, so its display name is a literal lookup
        # (a join on a constant key would be a nested-loop join)
        org_name_literal(org).alias("org_name"),
    )


def summary_aggs() -> list[Column]:
    """Everything the summary takes from the per-track roll-up, in one aggregation."""
    return [*S.totals_aggs(), *S.hour_aggs(), *S.direction_aggs(), *S.direction4_aggs()]


def summary_columns(hours: Column, freight_entries: Column, zones_active: Column) -> list[Column]:
    """The summary's KPIs from ``summary_aggs`` and ``_best``, the best hour."""
    total = F.col("total_detections")
    return [
        total,
        "pedestrian_count",
        "vehicle_count",
        S.composition_expr(total, F.col("pedestrian_count")).alias("pedestrian_pct"),
        S.composition_expr(total, F.col("vehicle_count")).alias("vehicle_pct"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in SPEED_FIELDS],
        round_half_even(total / hours, 0).cast("long").alias("flow_rate_per_hour"),
        freight_entries.alias("freight_entries"),
        S.peak_hour_expr(F.col("_best")).alias("peak_hour"),
        zones_active.alias("zones_active"),
        *[F.col(f"dir_{d}").cast("long").alias(f"dir_{d}") for d in COMPASS_LABELS],
        *[
            F.col(f"dir4_{t}_{c}").cast("long").alias(f"dir4_{t}_{c}")
            for t in ("pedestrian", "vehicle")
            for c in CARDINAL_LABELS
        ],
        *[
            (F.col(f"dir4_pedestrian_{c}") + F.col(f"dir4_vehicle_{c}")).cast("long").alias(f"dir4_all_{c}")
            for c in CARDINAL_LABELS
        ],
    ]


def summary_record(flat: DataFrame) -> DataFrame:
    """The nested summary document (composition, direction maps, period)."""

    def cmap(keys, prefix):
        return F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"{prefix}{k}"))])

    return flat.select(
        "total_detections",
        "pedestrian_count",
        "vehicle_count",
        F.struct("pedestrian_pct", "vehicle_pct").alias("composition"),
        *SPEED_FIELDS,
        "flow_rate_per_hour",
        "freight_entries",
        "peak_hour",
        "zones_active",
        cmap(COMPASS_LABELS, "dir_").alias("directions"),
        F.create_map(
            *[
                x
                for t in ("all", "pedestrian", "vehicle")
                for x in (F.lit(t), cmap(CARDINAL_LABELS, f"dir4_{t}_"))
            ]
        ).alias("directions_4way"),
        F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end")).alias("period"),
        "org_subdomain",
        "org_name",
    )


def zone_features(features: DataFrame) -> DataFrame:
    """Features that have a geometry; missing metadata becomes ``{}``."""
    return features.where(F.col("geometry").isNotNull()).select(
        "feature_id",
        "feature_name",
        "feature_type",
        "geometry",
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
    )


def feature_json() -> Column:
    """One GeoJSON Feature; metadata that is no JSON becomes ``{}``."""
    metadata = F.coalesce(F.try_parse_json(F.col("metadata")), F.parse_json(F.lit("{}")))
    return F.concat(
        F.lit('{"type":"Feature","geometry":'),
        F.col("geometry"),
        F.lit(',"properties":'),
        F.to_json(F.struct("feature_id", "feature_name", "feature_type", metadata.alias("metadata"))),
        F.lit("}"),
    )


def feature_lines(features: DataFrame) -> DataFrame:
    """The FeatureCollection document as lines in order, one feature each, in one partition.

    A document is one file, which one task writes line by line; no row and
    no group ever holds more than one feature.
    """
    lines = zone_features(features).select(F.lit(1).alias("part"), "feature_id", feature_json().alias("line"))
    spark = features.sparkSession
    ends = spark.createDataFrame(
        [(0, None, '{"type":"FeatureCollection","features":['), (2, None, "]}")], "part int, feature_id string, line string"
    )
    ordered = lines.union(ends).repartitionByRange(1, "part").sortWithinPartitions("part", "feature_id", "line")
    ordered = ordered.withColumn("n", F.monotonically_increasing_id())  # the opening line is number 0
    comma = F.when((F.col("part") == 1) & (F.col("n") > 1), ",").otherwise("")
    return ordered.select(F.concat(comma, "line").alias("value"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One GeoJSON FeatureCollection document (text).

    For a page that takes a small site plan in one piece; the report is
    written from :func:`feature_lines`.
    """
    f = zone_features(features).select("feature_id", feature_json().alias("feature"))
    return f.agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.coalesce(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "feature"))), lambda s: s["feature"]),
                    ",",
                ),
                F.lit(""),
            ),
            F.lit("]}"),
        ).alias("geojson")
    )


def feature_type_counts(features: DataFrame) -> DataFrame:
    """Features with a geometry per type (zone / subzone)."""
    return zone_features(features).groupBy("feature_type").agg(F.count(F.lit(1)).alias("features"))


def daily_periods(det: DataFrame) -> DataFrame:
    """Each UTC day with detections as a report period and its folder slug."""
    day = F.to_date("timestamp").cast("string")
    d = det.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("detections"))
    start = F.concat(F.col("day"), F.lit("T00:00:00"))
    end = F.concat(F.col("day"), F.lit("T23:59:59"))
    return d.select(
        start.alias("period_start"),
        end.alias("period_end"),
        F.concat(F.split(start, "T")[0], F.lit("_to_"), F.split(end, "T")[0]).alias("period_slug"),
        "detections",
    )


def report_index(det: DataFrame, org: str) -> DataFrame:
    """Daily report periods of one tenant with its display name (an
    unknown slug names itself) and snapshot folder slug."""
    return daily_periods(det).select(
        F.lit(validate_slug(org)).alias("org_subdomain"),
        org_name_literal(org).alias("org_name"),
        "period_slug",
        "detections",
    )


def snapshot_path(root: str, org: str, period: Period) -> str:
    validate_slug(org)
    return f"{root.rstrip('/')}/org={org}/period={period.slug()}"


def sink_order() -> dict[str, list]:
    """Sort order of each published result (as the report pages receive them)."""
    return {
        "timeline": ["bin_start", "object_type"],
        "speed-profile": [F.col("avg_speed").desc_nulls_last(), "track_id"],
        "zone-stats": [F.col("detections").desc(), "zone", "object_type"],
        "heatmap": [F.col("point_count").desc(), "lon", "lat", "device_id"],
        "map-heatmap": [F.col("point_count").desc(), "lon", "lat", "device_id"],
        "map-tracks": ["track_id", "timestamp"],
    }


def build_report(
    spark: SparkSession,
    raw: DataFrame,
    org: str,
    period: Period,
    out_root: str,
    thin: ThinParams = ThinParams(),
    heat_precision: int = DEFAULT_PRECISION,
    heat_min_points: int = DEFAULT_MIN_POINTS,
    map_precision: int = DEFAULT_PRECISION,
    map_min_points: int = DEFAULT_MIN_POINTS,
    fmt: str = "json",
    features: DataFrame | None = None,
    date_col: str | None = None,
) -> dict[str, str]:
    """Write every report result for one tenant and period.

    ``features`` is the tenant's feature table; by default it is read from
    the catalog (a missing table gives an empty collection). ``date_col``
    names the raw table's date partition column, if it has one.

    The typed, period-filtered scan, the per-track roll-up and the heatmap
    cells are each written once as Parquet under the cluster's shared
    checkpoint folder and removed at the end. The results are written into a
    version folder of the snapshot, which readers find only through the
    snapshot's pointer: one small file that is written last and never again.
    A snapshot so is whole or not there, on object stores as well, where
    folders can't be renamed at once.
    """
    base = snapshot_path(out_root, org, period)
    if is_published(spark, base):
        raise FileExistsError(f"snapshot already published: {base}")
    version = f"v-{uuid.uuid4().hex}"
    building = f"{base}/{version}"
    staged: list[DataFrame] = []

    def held(df: DataFrame, title: str) -> DataFrame:
        staged.append(stage_table(df, title, scratch_dir(spark)))
        return staged[-1]

    try:
        det = held(normalise(period_filter(raw, period, date_col)), "detections")
        roll = held(track_rollup(det), "rollup")
        cells = map_cells = held(heatmap(det, heat_precision, heat_min_points), "cells")
        if (map_precision, map_min_points) != (heat_precision, heat_min_points):
            map_cells = heatmap(det, map_precision, map_min_points)
        results = {
            "summary": summary_record(summary(roll, track_zones(det), period, org, spark)),
            "timeline": sinks.timeline_records(timeline(det)),
            "speed-profile": sinks.speed_profile_records(speed_profile(det)),
            "zone-stats": sinks.zone_stats_records(zone_stats(det)),
            "direction-rose": sinks.rose_records(direction_rose(roll)),
            "heatmap": sinks.heatmap_records(cells),
            "map-heatmap": sinks.heatmap_records(map_cells),
            "map-tracks": sinks.map_track_records(map_tracks(det, thin)),
            "zones": feature_lines(features if features is not None else features_table(spark, org)),
        }
        order = sink_order()
        for name, df in results.items():
            ordered = df.orderBy(*order[name]) if name in order else df
            # the zones result is one GeoJSON document: its lines are written as they are
            ordered.write.mode("errorifexists").format("text" if name == "zones" else fmt).save(f"{building}/{name}")
        manifest = {"org": org, "period": [period.start, period.end], "results": sorted(results), "format": fmt}
        if thin.max_tracks is not None:
            manifest |= {"max_tracks": thin.max_tracks, "tracks_left_out": left_out(det, thin.max_tracks).first()[0]}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{building}/{MANIFEST}")
        _point(spark, base, version)
    except BaseException:
        if _exists(spark, building):
            remove_path(spark, building)
        raise
    finally:
        for df in staged:
            unstage(df)
    return {name: f"{building}/{name}" for name in results}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _point(spark: SparkSession, base: str, version: str) -> None:
    """Publish a version: create the snapshot's pointer, which must not be there."""
    p, fs = _path(spark, f"{base}/{POINTER}")
    if fs.exists(p):
        raise FileExistsError(f"snapshot already published: {base}")
    out = fs.create(p, False)
    out.write(bytearray(f"{version}\n".encode()))
    out.close()


def current_version(spark: SparkSession, base: str) -> str | None:
    """The folder of a snapshot's published version; None without a pointer or with one that isn't whole."""
    if not _exists(spark, f"{base}/{POINTER}"):
        return None
    text = spark.read.text(f"{base}/{POINTER}", wholetext=True).first()
    return f"{base}/{text[0].strip()}" if text and text[0].endswith("\n") else None


def is_published(spark: SparkSession, base: str) -> bool:
    """A snapshot counts once its pointer is whole."""
    return current_version(spark, base) is not None


def read_result(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    """Load a published result with its declared schema (no inference)."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_report(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All results of a published snapshot, each with its declared schema; ``zones`` as lines of its document."""
    folder = current_version(spark, base)
    if folder is None:
        raise FileNotFoundError(f"no published snapshot: {base}")
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()[0])
    return {
        name: read_result(spark, f"{folder}/{name}", schema, "text" if name == "zones" else manifest["format"])
        for name, schema in sinks.result_schemas().items()
    }


__all__ = [
    "summary",
    "summary_record",
    "zone_features",
    "feature_collection",
    "feature_type_counts",
    "daily_periods",
    "snapshot_path",
    "build_report",
    "feature_lines",
    "current_version",
    "is_published",
    "read_report",
    "read_result",
]
