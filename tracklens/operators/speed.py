"""Per-track mean speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_up, to_mph
from tracklens.functions.classes import type_total


def speed_profile(det: DataFrame) -> DataFrame:
    """track_id, object_type, avg_speed (mph, 1 dp; NULL when no speed).

    A track seen with both classes yields one row per class.
    """
    return det.groupBy(
        F.col("track_identifier").alias("track_id"),
        type_total(F.col("object_type")).alias("object_type"),
    ).agg(round_half_up(to_mph(F.avg("speed_ms")), 1).alias("avg_speed"))
