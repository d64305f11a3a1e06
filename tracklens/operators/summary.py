"""Summary KPIs: counts, speeds, peak hour, directions, zones, flow rate.

All components are global aggregates over the per-track roll-up
(``rollup.track_rollup``).  Zero-filled direction tables come from
conditional counts unpivoted into rows, so no dimension join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_even, round_half_up, to_mph
from tracklens.functions.compass import CARDINAL_LABELS, COMPASS_LABELS
from tracklens.params import FREIGHT_ZONE, Period

TRACK_NAME = "track_identifier"


def _avg_mph(cls: str) -> Column:
    return round_half_up(
        to_mph(F.try_divide(F.sum(f"sp_sum_{cls}"), F.sum(f"sp_cnt_{cls}"))), 1
    )


def _max_mph(cls: str) -> Column:
    return round_half_up(to_mph(F.max(f"sp_max_{cls}")), 1)


def totals_aggs() -> list[Column]:
    """A1: distinct tracks (all / small / large) and mph speeds."""
    return [
        F.count(TRACK_NAME).alias("total_detections"),
        F.count_if(F.col(TRACK_NAME).isNotNull() & F.col("has_small")).alias("pedestrian_count"),
        F.count_if(F.col(TRACK_NAME).isNotNull() & F.col("has_large")).alias("vehicle_count"),
        _avg_mph("all").alias("avg_speed"),
        _max_mph("all").alias("top_speed"),
        _avg_mph("small").alias("ped_avg_speed"),
        _max_mph("small").alias("ped_top_speed"),
        _avg_mph("large").alias("veh_avg_speed"),
        _max_mph("large").alias("veh_top_speed"),
    ]


def hour_aggs() -> list[Column]:
    """Distinct (non-NULL) tracks seen in each UTC hour of day, and the hours with rows."""
    return [
        F.expr(
            f"sum(CASE WHEN {TRACK_NAME} IS NOT NULL THEN shiftright(hour_mask, {h}) & 1 ELSE 0 END)"
        ).alias(f"h{h:02d}")
        for h in range(24)
    ] + [F.bit_or("hour_mask").alias("hours_present")]


def _best_hour() -> Column:
    """(tracks, present, -hour) maximum: most tracks, then an hour with rows, then lowest."""
    items = ", ".join(
        f"named_struct('n', CAST(h{h:02d} AS BIGINT), 'present', shiftright(hours_present, {h}) & 1, 'neg', {-h})"
        for h in range(24)
    )
    return F.expr(f"array_max(array({items}))")


def peak_hour_expr(best: Column | None = None) -> Column:
    """Hour with the most tracks (lowest hour on ties) as "HH:00"; "00:00" if no rows.

    ``best`` is the ``_best_hour()`` struct when already projected.
    """
    best = _best_hour() if best is None else best
    hour = F.when(best["present"] > 0, -best["neg"]).otherwise(F.lit(0))
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def direction_aggs() -> list[Column]:
    """A3: tracks per dominant 8-way direction (NULL direction ignored)."""
    return [F.count_if(F.col("dom_compass") == d).alias(f"dir_{d}") for d in COMPASS_LABELS]


def direction4_aggs() -> list[Column]:
    """A4: tracks per (class, dominant cardinal)."""
    out = []
    for cls, col in (("pedestrian", "ped_card"), ("vehicle", "veh_card")):
        for c in CARDINAL_LABELS:
            out.append(F.count_if(F.col(col) == c).alias(f"dir4_{cls}_{c}"))
    return out


def zones_active(zones: DataFrame) -> DataFrame:
    """A5: number of distinct zone names over all tracks (loader parse rule)."""
    return zones.agg(F.count_distinct("zone").alias("zones_active"))


def zone_figures(zones: DataFrame, zone: str = FREIGHT_ZONE) -> DataFrame:
    """A5 and A6 in one aggregation: struct(zones_active, freight_entries)."""
    return zones.agg(
        F.struct(
            F.count_distinct("zone").alias("zones_active"),
            F.count_if(F.col("zone") == zone).alias("freight_entries"),
        ).alias("z")
    )


def freight_entries(zones: DataFrame, zone: str = FREIGHT_ZONE) -> DataFrame:
    """A6: tracks that ever hit ``zone`` (a NULL track id counts as one)."""
    return zones.where(F.col("zone") == zone).agg(F.count(F.lit(1)).alias("freight_entries"))


def summary_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(*totals_aggs())


def peak_hour(rollup: DataFrame) -> DataFrame:
    hours = rollup.agg(*hour_aggs()).select(_best_hour().alias("_best"))
    best = F.col("_best")
    return hours.select(
        peak_hour_expr(best).alias("peak_hour"),
        F.when(best["present"] > 0, best["n"]).otherwise(F.lit(0)).cast("long").alias("tracks"),
    )


def direction_counts(rollup: DataFrame) -> DataFrame:
    """8 rows (direction, tracks), zero-filled."""
    wide = rollup.agg(*direction_aggs())
    return wide.unpivot([], [f"dir_{d}" for d in COMPASS_LABELS], "key", "tracks").select(
        F.substring("key", 5, 4).alias("direction"), F.col("tracks").cast("long").alias("tracks")
    )


def direction_4way(rollup: DataFrame) -> DataFrame:
    """12 rows (object_type in all/pedestrian/vehicle, cardinal, tracks).

    "all" adds the class rows, so a track seen as both classes counts twice.
    """
    wide = rollup.agg(*direction4_aggs())
    wide = wide.select(
        "*",
        *[
            (F.col(f"dir4_pedestrian_{c}") + F.col(f"dir4_vehicle_{c}")).alias(f"dir4_all_{c}")
            for c in CARDINAL_LABELS
        ],
    )
    cols = [f"dir4_{t}_{c}" for t in ("all", "pedestrian", "vehicle") for c in CARDINAL_LABELS]
    long = wide.unpivot([], cols, "key", "tracks")
    parts = F.split(F.col("key"), "_")
    return long.select(
        parts[1].alias("object_type"),
        parts[2].alias("cardinal"),
        F.col("tracks").cast("long").alias("tracks"),
    )


def zone_entry_tracks(zones: DataFrame, zone: str = FREIGHT_ZONE) -> DataFrame:
    return freight_entries(zones, zone).select(F.lit(zone).alias("zone"), F.col("freight_entries").alias("tracks"))


def composition_expr(total: Column, part: Column) -> Column:
    """round(100 * part / total) with Python's half-even rule; 0 when empty."""
    return F.when(total > 0, round_half_even(part / total * 100, 0).cast("long")).otherwise(F.lit(0).cast("long"))


def composition(rollup: DataFrame) -> DataFrame:
    t = rollup.agg(*totals_aggs())
    return t.select(
        composition_expr(F.col("total_detections"), F.col("pedestrian_count")).alias("pedestrian_pct"),
        composition_expr(F.col("total_detections"), F.col("vehicle_count")).alias("vehicle_pct"),
    )


def flow_rate(rollup: DataFrame, period: Period) -> DataFrame:
    """Distinct tracks per hour of the period, rounded half-even."""
    hours = period.hours()
    t = rollup.agg(F.count(TRACK_NAME).alias("total_detections"))
    return t.select(
        F.lit(float(hours)).alias("period_hours"),
        round_half_even(F.col("total_detections") / F.lit(float(hours)), 0).cast("long").alias("flow_rate_per_hour"),
    )
