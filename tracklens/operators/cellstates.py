"""Heatmaps of any days from stored daily states.

A daily state holds one row per (day, cell, track): speed sum and count, top
speed, first and last time.  These merge exactly (a track seen on two days is
one track of the period), so a heatmap of any run of whole days comes from
the states alone and raw rows are read once, on their day.  States are kept
in folders by day; storing a day again replaces that day and no other.

``sketches`` are the small form: per (day, cell) a distinct-track sketch of
fixed size instead of the tracks, for estimates over very long spans.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_up
from tracklens.operators.heatmap import CELL_KEYS, finished_cells, placed
from tracklens.params import DEFAULT_MIN_POINTS, DEFAULT_PRECISION

SKETCH_BITS = 12  # lgK of a distinct-track sketch: 4,096 buckets, about 1.6 % standard error


def cell_points(det: DataFrame, precision: int = DEFAULT_PRECISION) -> DataFrame:
    """Placed detections with their cell and UTC day; a detection without a time has no day and is left out."""
    return det.where(placed() & F.col("timestamp").isNotNull()).select(
        F.to_date("timestamp").alias("day"),
        round_half_up(F.col("lon"), precision).alias("lon"),
        round_half_up(F.col("lat"), precision).alias("lat"),
        F.col("object_type").alias("raw_type"),
        F.col("device_identifier").alias("device_id"),
        "track_identifier",
        "speed_ms",
        "timestamp",
    )


def _speed_and_times() -> list[Column]:
    return [
        F.sum("speed_ms").alias("s"),
        F.count("speed_ms").alias("n"),
        F.max("speed_ms").alias("m"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    ]


def daily_states(det: DataFrame, precision: int = DEFAULT_PRECISION) -> DataFrame:
    """One row per (day, cell, track); combines map-side, whatever the skew of cells or tracks."""
    return cell_points(det, precision).groupBy("day", *CELL_KEYS, "track_identifier").agg(*_speed_and_times())


def daily_sketches(det: DataFrame, precision: int = DEFAULT_PRECISION) -> DataFrame:
    """One row per (day, cell) with a sketch of its tracks."""
    tracks = F.hll_sketch_agg("track_identifier", F.lit(SKETCH_BITS)).alias("tracks")
    return cell_points(det, precision).groupBy("day", *CELL_KEYS).agg(tracks, *_speed_and_times())


def store_days(states: DataFrame, path: str) -> None:
    """Write states by day; the days among ``states`` are replaced, all others stay as they are."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """The states of the days from ``first`` to ``last``; the folders of other days are not read."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first), F.lit(last)))


def _merged() -> list[Column]:
    return [
        F.sum("s").alias("s"),
        F.sum("n").alias("n"),
        F.max("m").alias("m"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    ]


def heatmap_of_states(states: DataFrame, min_points: int = DEFAULT_MIN_POINTS) -> DataFrame:
    """The heatmap of all days in ``states``: days are merged per (cell, track), then tracks per cell."""
    per_track = states.groupBy(*CELL_KEYS, "track_identifier").agg(*_merged())
    per_cell = per_track.groupBy(*CELL_KEYS).agg(F.count("track_identifier").alias("point_count"), *_merged())
    return finished_cells(per_cell.withColumns({"avg_ms": F.try_divide("s", "n"), "max_ms": F.col("m")}), min_points)


def heatmap_of_sketches(sketches: DataFrame, min_points: int = DEFAULT_MIN_POINTS) -> DataFrame:
    """The same with estimated track counts, from daily sketches."""
    tracks = F.hll_sketch_estimate(F.hll_union_agg("tracks")).alias("point_count")
    per_cell = sketches.groupBy(*CELL_KEYS).agg(tracks, *_merged())
    return finished_cells(per_cell.withColumns({"avg_ms": F.try_divide("s", "n"), "max_ms": F.col("m")}), min_points)
