"""JSON-record projections of results (what the report pages load)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.timefn import iso8601, is_ntz


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0.0)).alias(c)


def timeline_records(tl: DataFrame) -> DataFrame:
    return tl.select(iso8601(F.col("bin_start"), is_ntz(tl, "bin_start")).alias("bin_start"), "object_type", "count")


def heatmap_records(cells: DataFrame) -> DataFrame:
    """HeatmapCell rows: NULL speeds become 0, times ISO-8601."""
    ntz = is_ntz(cells, "first_seen")
    return cells.select(
        "lon",
        "lat",
        "object_type",
        "device_id",
        "point_count",
        _zero("avg_speed"),
        _zero("max_speed"),
        iso8601(F.col("first_seen"), ntz).alias("first_seen"),
        iso8601(F.col("last_seen"), ntz).alias("last_seen"),
    )


def speed_profile_records(sp: DataFrame) -> DataFrame:
    return sp.select("track_id", "object_type", _zero("avg_speed"))


def zone_stats_records(zs: DataFrame) -> DataFrame:
    return zs.select("zone", "object_type", "detections", _zero("avg_speed"), _zero("speed_sum"))


def rose_records(rose: DataFrame) -> DataFrame:
    return rose.select("direction", "object_type", "count", _zero("speed_sum"), _zero("avg_speed"))


def map_track_records(points: DataFrame) -> DataFrame:
    return points.select(
        "track_id",
        "object_type",
        "device_id",
        "longitude",
        "latitude",
        iso8601(F.col("timestamp"), is_ntz(points, "timestamp")).alias("timestamp"),
        "speed",
        "heading",
        "zones_hit",
    )


def result_schemas() -> dict:
    """Declared schemas of the published JSON results (read without inference)."""
    from pyspark.sql import types as T

    S, L, D = T.StringType(), T.LongType(), T.DoubleType()

    def st(*fields):
        return T.StructType([T.StructField(n, t) for n, t in fields])

    out = {
        "timeline": st(("bin_start", S), ("object_type", S), ("count", L)),
        "speed-profile": st(("track_id", S), ("object_type", S), ("avg_speed", D)),
        "zone-stats": st(("zone", S), ("object_type", S), ("detections", L), ("avg_speed", D), ("speed_sum", D)),
        "direction-rose": st(("direction", S), ("object_type", S), ("count", L), ("speed_sum", D), ("avg_speed", D)),
        "heatmap": st(
            ("lon", D), ("lat", D), ("object_type", S), ("device_id", S), ("point_count", L),
            ("avg_speed", D), ("max_speed", D), ("first_seen", S), ("last_seen", S),
        ),
        "map-tracks": st(
            ("track_id", S), ("object_type", S), ("device_id", S), ("longitude", D), ("latitude", D),
            ("timestamp", S), ("speed", D), ("heading", D), ("zones_hit", T.ArrayType(S)),
        ),
    }
    out["map-heatmap"] = out["heatmap"]
    counts = T.MapType(S, L)
    out["summary"] = st(
        ("total_detections", L), ("pedestrian_count", L), ("vehicle_count", L),
        ("composition", st(("pedestrian_pct", L), ("vehicle_pct", L))),
        ("avg_speed", D), ("top_speed", D), ("ped_avg_speed", D), ("ped_top_speed", D), ("veh_avg_speed", D),
        ("veh_top_speed", D), ("flow_rate_per_hour", L), ("freight_entries", L), ("peak_hour", S), ("zones_active", L),
        ("directions", counts), ("directions_4way", T.MapType(S, counts)),
        ("period", st(("start", S), ("end", S))), ("org_subdomain", S), ("org_name", S),
    )
    out["zones"] = st(("value", S))
    return out
