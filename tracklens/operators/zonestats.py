"""Zone statistics and per-track zone sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_up, to_mph
from tracklens.functions.classes import type_total
from tracklens.functions.zones import has_zones, zones_loader, zones_sql


def zones_expanded(det: DataFrame) -> DataFrame:
    """One row per (detection, listed zone) under the statistics rule."""
    return det.where(has_zones(F.col("zones_hit"))).select(
        "event_id",
        "track_identifier",
        type_total(F.col("object_type")).alias("object_type"),
        to_mph(F.col("speed_ms")).alias("speed_mph"),
        F.explode(zones_sql(F.col("zones_hit"))).alias("zone"),
    )


def zone_stats(det: DataFrame) -> DataFrame:
    """zone, object_type, detections (points), avg_speed, speed_sum (mph).

    A zone listed twice in one detection counts twice.
    """
    return (
        zones_expanded(det)
        .groupBy("zone", "object_type")
        .agg(
            F.count(F.lit(1)).alias("detections"),
            round_half_up(F.avg("speed_mph"), 1).alias("avg_speed"),
            round_half_up(F.sum("speed_mph"), 1).alias("speed_sum"),
        )
    )


def track_zone_sets(det: DataFrame) -> DataFrame:
    """track_identifier, zones: sorted distinct zones a track touched.

    Distinct (track, text) pairs are parsed, and distinct (track, zone)
    pairs gathered, so a track's list holds its zones and nothing else.
    """
    texts = det.where(has_zones(F.col("zones_hit"))).select("track_identifier", "zones_hit").distinct()
    zones = texts.select("track_identifier", F.explode_outer(zones_loader(F.col("zones_hit"))).alias("zone"))
    return zones.distinct().groupBy("track_identifier").agg(F.array_sort(F.collect_list("zone")).alias("zones"))
