"""Row-level projections: typed values, classes, sectors, zone lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import js_fixed, round_half_even, to_mph
from tracklens.functions.classes import type_partial, type_total
from tracklens.functions.compass import cardinal4, compass8
from tracklens.functions.zones import zones_loader


def typed_points(det: DataFrame) -> DataFrame:
    return det.select(
        "event_id",
        "track_identifier",
        "lon",
        "lat",
        "speed_ms",
        to_mph(F.col("speed_ms")).alias("speed_mph"),
        "heading",
    )


def type_classes(det: DataFrame, rule: str = "total") -> DataFrame:
    fn = type_total if rule == "total" else type_partial
    return det.select(
        "event_id", F.col("object_type").alias("raw_type"), fn(F.col("object_type")).alias("object_type")
    )


def heading_sectors(det: DataFrame) -> DataFrame:
    return det.select(
        "event_id",
        "heading_degrees",
        compass8(F.col("heading")).alias("compass"),
        cardinal4(F.col("heading")).alias("cardinal"),
    )


def zones_parsed(det: DataFrame) -> DataFrame:
    return det.select("event_id", "zones_hit", zones_loader(F.col("zones_hit")).alias("zones"))


def cardinal_sectors(det: DataFrame) -> DataFrame:
    return det.select("event_id", "heading_degrees", cardinal4(F.col("heading")).alias("cardinal"))


def exact_rounding(det: DataFrame) -> DataFrame:
    """Latitudes to five digits and a ladder of speeds to one, as Python and JavaScript print them."""
    ladder = (F.col("event_id") % 400).cast("double") / F.lit(20.0)
    return det.select("event_id", round_half_even(F.col("lat"), 5).alias("lat5"), js_fixed(ladder, 1).alias("fixed1"))
