"""Five-minute activity timeline (point counts per bin and class)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.classes import type_total
from tracklens.functions.timefn import floor_to, is_ntz
from tracklens.params import TIMELINE_BIN_MINUTES


def timeline(det: DataFrame, bin_minutes: int = TIMELINE_BIN_MINUTES) -> DataFrame:
    """bin_start, object_type (pedestrian/vehicle), count — sparse bins.

    One hash aggregation with map-side combine: the shuffle carries one row
    per (bin, class) per input partition, whatever the skew of tracks.
    """
    ntz = is_ntz(det, "timestamp")
    return det.groupBy(
        floor_to(F.col("timestamp"), ntz, bin_minutes * 60_000_000).alias("bin_start"),
        type_total(F.col("object_type")).alias("object_type"),
    ).agg(F.count(F.lit(1)).alias("count"))
