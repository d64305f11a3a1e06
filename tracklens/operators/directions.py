"""Dominant travel direction per track and the direction rose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_up
from tracklens.functions.classes import PEDESTRIAN, VEHICLE


def dominant_direction(rollup: DataFrame) -> DataFrame:
    """track_identifier, direction (8-way, may be NULL), direction_count.

    Only tracks with at least one raw heading in the period appear.
    """
    return rollup.where(F.col("has_heading")).select(
        "track_identifier",
        F.col("dom_compass").alias("direction"),
        F.col("dom_count").alias("direction_count"),
    )


def rose_tracks(rollup: DataFrame) -> DataFrame:
    """One row per (track, class) with a heading: dominant direction, mean mph."""
    sides = F.array(
        *[
            F.struct(
                F.lit(name).alias("object_type"),
                F.col(f"{p}_rose_dir").alias("direction"),
                F.col(f"{p}_rose_speed").alias("avg_speed"),
                F.col(f"{p}_has_heading").alias("present"),
            )
            for name, p in ((PEDESTRIAN, "ped"), (VEHICLE, "veh"))
        ]
    )
    return (
        rollup.where(F.col("track_identifier").isNotNull())
        .select("track_identifier", F.explode(sides).alias("s"))
        .where(F.col("s.present"))
        .select("track_identifier", "s.object_type", "s.direction", "s.avg_speed")
    )


def direction_rose(rollup: DataFrame) -> DataFrame:
    """direction, object_type, count (tracks), speed_sum, avg_speed (mph, 1 dp).

    The direction of a track whose dominant heading does not parse is NULL
    and forms its own row.
    """
    return (
        rose_tracks(rollup)
        .groupBy("direction", "object_type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            round_half_up(F.sum("avg_speed"), 1).alias("speed_sum"),
            round_half_up(F.avg("avg_speed"), 1).alias("avg_speed"),
        )
    )
