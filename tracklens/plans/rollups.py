"""Roll-ups the report page derives from published results.

Inputs are already-reduced result tables (a few rows per direction, zone,
track or cell), so these are cheap; they still run as Spark plans so the
report can be rebuilt for any tenant and period in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.functions.casting import fixed6, js_fixed, js_round
from tracklens.functions.classes import PEDESTRIAN, VEHICLE
from tracklens.functions.compass import CARDINAL_LABELS, COMPASS_LABELS
from tracklens.functions.geo import hex_cell, hex_center, mercator_inverse, mercator_xy
from tracklens.functions.labels import search_terms, term_pattern, zone_label, zone_title
from tracklens.functions.timefn import epoch_ms, is_ntz
from tracklens.operators.filters import type_filter
from tracklens.params import DEFAULT_HEX_RADIUS_M, Period


def rose_bins(rose: DataFrame, choice: str = "All") -> DataFrame:
    """Eight direction bins (N..NW) with class counts and mean speeds.

    ``rose`` holds direction-rose records (NULL speed sums already 0).
    Missing (direction, class) rows count as zero; the NULL direction row
    is not one of the bins.
    """
    r = type_filter(rose, choice)
    aggs = []
    for d in COMPASS_LABELS:
        for cls, p in ((PEDESTRIAN, "p"), (VEHICLE, "v")):
            hit = (F.col("direction") == d) & (F.col("object_type") == cls)
            aggs += [
                F.sum(F.when(hit, F.col("count")).otherwise(0)).alias(f"{p}n_{d}"),
                F.sum(F.when(hit, F.col("speed_sum")).otherwise(0.0)).alias(f"{p}s_{d}"),
            ]
    wide = r.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("label"),
                F.col(f"pn_{d}").cast("long").alias("pedestrian"),
                F.col(f"vn_{d}").cast("long").alias("vehicle"),
                F.col(f"ps_{d}").alias("ps"),
                F.col(f"vs_{d}").alias("vs"),
            )
            for d in COMPASS_LABELS
        ]
    )
    b = wide.select(F.inline(rows))
    total = F.col("pedestrian") + F.col("vehicle")

    def mean(s: Column, n: Column) -> Column:
        return F.when(n > 0, s / n).otherwise(F.lit(0.0))

    return b.select(
        "label",
        "pedestrian",
        "vehicle",
        total.alias("total"),
        mean(F.col("ps"), F.col("pedestrian")).alias("pedAvgSpeed"),
        mean(F.col("vs"), F.col("vehicle")).alias("vehAvgSpeed"),
        mean(F.col("ps") + F.col("vs"), total).alias("avgSpeed"),
    )


def zone_rollup(zone_stats: DataFrame, choice: str = "All") -> DataFrame:
    """Per zone over classes: detections, mean speed (Σ speed / Σ detections,
    1 dp), pedestrian and vehicle shares (whole percent, halves up)."""
    z = type_filter(zone_stats, choice)
    g = z.groupBy("zone").agg(
        F.sum("detections").alias("detections"),
        F.sum(F.coalesce(F.col("speed_sum"), F.lit(0.0))).alias("speed_sum"),
        F.sum(F.when(F.col("object_type") == PEDESTRIAN, F.col("detections")).otherwise(0)).alias("ped"),
        F.sum(F.when(F.col("object_type") != PEDESTRIAN, F.col("detections")).otherwise(0)).alias("veh"),
    )
    det = F.col("detections")

    def share(part: str) -> Column:
        return F.when(det > 0, js_round(F.col(part) / det * 100)).otherwise(F.lit(0).cast("long"))

    return g.select(
        zone_label(F.col("zone")).alias("zone"),
        det.cast("long").alias("detections"),
        F.when(det > 0, js_fixed(F.col("speed_sum") / det, 1)).otherwise(F.lit(0.0)).alias("avg_speed"),
        share("ped").alias("pedestrian_pct"),
        share("veh").alias("vehicle_pct"),
    )


def zone_labels(zone_stats: DataFrame) -> DataFrame:
    """zone, label (underscores as spaces), title (each word capitalised)."""
    z = zone_stats.select("zone").distinct()
    return z.select("zone", zone_label(F.col("zone")).alias("label"), zone_title(F.col("zone")).alias("title"))


def summary_by_filter(summary: DataFrame, period: Period) -> DataFrame:
    """The summary as the page shows it under each type filter.

    Counts, speeds and the 4-way directions follow the filter; composition
    and flow rate are recomputed (halves up; hours from the period as the
    browser parses it); peak hour and zones stay unfiltered.
    """
    hours = float(period.browser_hours())
    views = []
    for name, total, ped, veh, avg, top, key in (
        ("All", "total_detections", "pedestrian_count", "vehicle_count", "avg_speed", "top_speed", "all"),
        ("Pedestrian", "pedestrian_count", "pedestrian_count", None, "ped_avg_speed", "ped_top_speed", "pedestrian"),
        ("Vehicle", "vehicle_count", None, "vehicle_count", "veh_avg_speed", "veh_top_speed", "vehicle"),
    ):
        views.append(
            F.struct(
                F.lit(name).alias("filter"),
                F.col(total).alias("total"),
                (F.col(ped) if ped else F.lit(0).cast("long")).alias("ped"),
                (F.col(veh) if veh else F.lit(0).cast("long")).alias("veh"),
                F.col(avg).alias("avg_speed"),
                F.col(top).alias("top_speed"),
                *[F.col(f"dir4_{key}_{c}").alias(f"dir_{c}") for c in CARDINAL_LABELS],
            )
        )
    v = summary.select("peak_hour", "zones_active", F.explode(F.array(*views)).alias("v"))
    total = F.col("v.total")

    def pct(part: str) -> Column:
        return F.when(total > 0, js_round(F.col(f"v.{part}") / total * 100)).otherwise(F.lit(0).cast("long"))

    return v.select(
        F.col("v.filter").alias("filter"),
        total.alias("total_detections"),
        F.col("v.ped").alias("pedestrian_count"),
        F.col("v.veh").alias("vehicle_count"),
        pct("ped").alias("pedestrian_pct"),
        pct("veh").alias("vehicle_pct"),
        F.col("v.avg_speed").alias("avg_speed"),
        F.col("v.top_speed").alias("top_speed"),
        js_round(total / F.lit(hours)).alias("flow_rate_per_hour"),
        "peak_hour",
        "zones_active",
        *[F.col(f"v.dir_{c}").alias(f"dir_{c}") for c in CARDINAL_LABELS],
    )


def speed_box_stats(speed_profile: DataFrame, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Per class: min, q1, median, q3, max, count of per-track mean speeds.

    Quartiles interpolate linearly between order statistics (exact); the
    values are rounded to 1 dp upstream, so the exact percentile state is
    bounded by the number of distinct speeds, not of tracks.  ``exact=False``
    uses a fixed-size quantile sketch (``percentile_approx``, rank error
    about 1/``accuracy``, no interpolation) for unrounded inputs.
    """
    s = speed_profile.where(F.col("object_type").isin(PEDESTRIAN, VEHICLE))
    probs = [0.25, 0.5, 0.75]
    quartiles = (
        F.percentile(F.col("avg_speed"), probs)
        if exact
        else F.percentile_approx(F.col("avg_speed"), probs, accuracy)
    )
    q = s.groupBy("object_type").agg(
        F.min("avg_speed").alias("min"),
        quartiles.alias("q"),
        F.max("avg_speed").alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    return q.select(
        "object_type",
        "min",
        fixed6(F.col("q")[0]).alias("q1"),
        fixed6(F.col("q")[1]).alias("median"),
        fixed6(F.col("q")[2]).alias("q3"),
        "max",
        "count",
    )


def speed_whiskers(speed_profile: DataFrame) -> DataFrame:
    """Box-plot whiskers: extremes within 1.5 IQR of the quartiles, and the
    number of outliers beyond.  The quartile table has one row per class,
    so the planner sends it to the values."""
    box = speed_box_stats(speed_profile).select(
        "object_type",
        "q1",
        "q3",
        (F.col("q1") * 2.5 - F.col("q3") * 1.5).alias("lo_fence"),
        (F.col("q3") * 2.5 - F.col("q1") * 1.5).alias("hi_fence"),
    )
    s = speed_profile.where(F.col("object_type").isin(PEDESTRIAN, VEHICLE))
    j = s.join(box, "object_type")
    x = F.col("avg_speed")
    return j.groupBy("object_type", "lo_fence", "hi_fence").agg(
        F.min(F.when(x >= F.col("lo_fence"), x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("hi_fence"), x)).alias("whisker_high"),
        F.count_if((x < F.col("lo_fence")) | (x > F.col("hi_fence"))).alias("outliers"),
    )


def speed_outliers(speed_profile: DataFrame) -> DataFrame:
    """The tracks beyond the whiskers' fences (1.5 IQR from the quartiles)."""
    box = speed_box_stats(speed_profile).select(
        F.col("object_type").alias("_type"),
        (F.col("q1") * 2.5 - F.col("q3") * 1.5).alias("lo_fence"),
        (F.col("q3") * 2.5 - F.col("q1") * 1.5).alias("hi_fence"),
    )
    x = F.col("avg_speed")
    beyond = (x < F.col("lo_fence")) | (x > F.col("hi_fence"))
    return speed_profile.join(box, F.col("object_type") == F.col("_type")).where(beyond).select(
        "track_id", "object_type", "avg_speed"
    )


def bounds(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
    )


def hex_density(
    cells: DataFrame, radius_m: float = DEFAULT_HEX_RADIUS_M, ref_lat: float | Column | None = None
) -> DataFrame:
    """Hexagon bins of radius ``radius_m`` metres over heatmap cells.

    Cells are projected with Web-Mercator scaled to metres at ``ref_lat``
    (default: the middle of the cells' latitude range), binned to the
    nearest hexagon centre, and summed: weight = Σ point_count.
    """
    return hex_densities(cells, [radius_m], ref_lat).drop("radius_m")


def hex_densities(cells: DataFrame, radii_m: list[float], ref_lat: float | Column | None = None) -> DataFrame:
    """Hexagon bins for every radius of the page's slider, from one scan of the cells.

    A cell goes to its hexagon of each radius and the bins of all radii are
    summed in one aggregation, map-side first. Every radius gets exactly the
    bins it has alone: hexagons of different sizes do not nest, so sums of
    small ones could only come near those of large ones.
    """
    if ref_lat is None:
        ref = cells.select((F.min("lat") + F.max("lat")) / 2).scalar()
    else:
        ref = ref_lat if isinstance(ref_lat, Column) else F.lit(float(ref_lat))
    c = cells.withColumn("_ref", ref)
    x, y = mercator_xy(F.col("lon"), F.col("lat"), F.col("_ref"))
    bins = []
    for radius in radii_m:
        col, row = hex_cell(F.col("_x"), F.col("_y"), float(radius))
        bins.append(F.struct(F.lit(float(radius)).alias("radius_m"), col.alias("hex_col"), row.alias("hex_row")))
    placed = c.select(x.alias("_x"), y.alias("_y"), "point_count", "_ref")
    binned = placed.select("point_count", "_ref", F.inline(F.array(*bins)))
    g = binned.groupBy("radius_m", "hex_col", "hex_row").agg(
        F.sum("point_count").alias("weight"),
        F.count(F.lit(1)).alias("cells"),
        F.first("_ref").alias("_ref"),
    )
    cx, cy = hex_center(F.col("hex_col"), F.col("hex_row"), F.col("radius_m"))
    lon, lat = mercator_inverse(cx, cy, F.col("_ref"))
    return g.select(
        "radius_m", "hex_col", "hex_row", "weight", "cells", fixed6(lon).alias("center_lon"), fixed6(lat).alias("center_lat")
    )


def histogram_columns(
    timeline: DataFrame, time_range: DataFrame | tuple[int, int], n_columns: int, choice: str = "All"
) -> DataFrame:
    """Timeline counts re-binned into ``n_columns`` equal columns over the
    map's time span; bins outside the span (before its first point) drop.
    Only non-empty columns are returned.

    ``time_range`` is the one-row ``(time_min_ms, time_max_ms,
    time_range_ms)`` frame, read by scalar subqueries, or its first and last
    number.
    """
    tl = type_filter(timeline, choice)
    if isinstance(time_range, DataFrame):
        t_min, t_rng = (time_range.select(c).scalar() for c in ("time_min_ms", "time_range_ms"))
    else:
        t_min, t_rng = (F.lit(x).cast("long") for x in time_range)
    ms = epoch_ms(F.col("bin_start"), is_ntz(timeline, "bin_start"))
    dur = t_rng.cast("double") / F.lit(float(n_columns))
    # a zero span (a single instant) has no columns; try_divide keeps it NULL
    idx = F.floor(F.try_divide((ms - t_min).cast("double"), dur)).cast("long")
    b = tl.select(idx.alias("column"), "object_type", "count").where(
        (t_rng > 0) & (F.col("column") >= 0) & (F.col("column") < n_columns)
    )
    return b.groupBy("column").agg(
        F.sum(F.when(F.col("object_type") == PEDESTRIAN, F.col("count")).otherwise(0)).alias("pedestrian"),
        F.sum(F.when(F.col("object_type") != PEDESTRIAN, F.col("count")).otherwise(0)).alias("vehicle"),
    )


# --- fixed values: the page's column names ---
HEATMAP_DISPLAY = [
    ("object_type", "Type"),
    ("device_id", "Device"),
    ("lon", "Longitude"),
    ("lat", "Latitude"),
    ("point_count", "Point Count"),
    ("avg_speed", "Avg Speed"),
    ("max_speed", "Max Speed"),
    ("first_seen", "First Seen"),
    ("last_seen", "Last Seen"),
]
SPEED_DISPLAY = [("object_type", "Type"), ("track_id", "Track ID"), ("avg_speed", "Avg Speed (mph)")]
# ---------------------------------------------


def raw_table(records: DataFrame, source: str = "Heatmap") -> DataFrame:
    """Raw-data table with display column names (heatmap or speed profile)."""
    cols = HEATMAP_DISPLAY if source == "Heatmap" else SPEED_DISPLAY
    return records.select(*[F.col(c).alias(label) for c, label in cols])


def search_texts(table: DataFrame) -> list[Column]:
    """Every column as the text the page shows, NULL as the empty one."""

    def text(field) -> Column:
        t = F.col(f"`{field.name}`").cast("string")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            t = F.regexp_replace(t, r"\.0$", "")  # integral numbers print without ".0"
        return F.coalesce(t, F.lit(""))

    return [text(f) for f in table.schema.fields]


def raw_search(table: DataFrame, query: str) -> DataFrame:
    """Rows where every query term starts a word in some column (any case)."""
    terms = search_terms(query)
    if not terms:
        return table
    texts = search_texts(table)
    cond = None
    for t in terms:
        pat = term_pattern(t)
        any_col = None
        for tx in texts:
            m = tx.rlike(pat)
            any_col = m if any_col is None else (any_col | m)
        cond = any_col if cond is None else (cond & any_col)
    return table.where(cond)
