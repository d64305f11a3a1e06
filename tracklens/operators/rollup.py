"""Per-track roll-up shared by the summary, direction and rose results.

Everything the summary needs is reduced in two map-side-combined hash
aggregations — per (track, raw type), then per track — so the raw rows are
scanned once and only small partial aggregates are shuffled.  A hot track
or a hot type costs no more than any other key: partial aggregation
collapses it before the exchange.  All buffers are primitive (counts,
sums, bit masks, packed arg-max scores), so both steps stay in generated
code.

Per (track, raw type) the first step keeps speed sums, compass / cardinal
counts of the rows that carry a heading, and an hour-of-day bit mask (for
the distinct-track peak hour).  The second step folds raw types into:

* totals by exact raw class (``small`` / ``large`` / all),
* the dominant 8-way direction of the track over all its rows,
* the dominant 4-way direction per mapped class, picked as the largest
  (raw type, direction) count — counts of different raw types that map to
  the same class are *not* added (as the reference query does),
* the dominant 8-way direction and mean mph of the heading rows per mapped
  class (here raw types *are* merged first, as the rose query does).

Ties go to the alphabetically first label, NULL last.  Zone sets are a
separate, smaller path (:func:`track_zones`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import to_mph
from tracklens.functions.classes import RAW_LARGE, RAW_SMALL
from tracklens.functions.compass import (
    CARDINAL_LABELS,
    COMPASS_LABELS,
    argmax_score,
    cardinal4,
    compass8,
    score_count,
    score_label,
)
from tracklens.functions.zones import has_zones, zones_loader

COMPASS_CATS: list[str | None] = [*COMPASS_LABELS, None]


def _cname(prefix: str, lab: str | None) -> str:
    return f"{prefix}_{lab if lab is not None else 'null'}"


def track_raw_rollup(det: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first step's states per (``keys``, track, raw type); they merge, see :func:`merged_raw`."""
    has_h = F.col("heading_degrees").isNotNull()
    comp = compass8(F.col("heading"))
    card = cardinal4(F.col("heading"))
    aggs = [
        F.sum("speed_ms").alias("sp_sum"),
        F.count("speed_ms").alias("sp_cnt"),
        F.max("speed_ms").alias("sp_max"),
        F.sum(F.when(has_h, to_mph(F.col("speed_ms")))).alias("hsp_sum"),
        F.count(F.when(has_h, F.col("speed_ms"))).alias("hsp_cnt"),
        F.count_if(has_h).alias("h_rows"),
        F.bit_or(F.pow(F.lit(2), F.hour("timestamp")).cast("int")).alias("hour_mask"),
    ]
    for lab in COMPASS_CATS:
        cond = comp.isNull() if lab is None else (comp == lab)
        aggs.append(F.count_if(has_h & cond).alias(_cname("c", lab)))
    for lab in CARDINAL_LABELS:
        aggs.append(F.count_if(has_h & (card == lab)).alias(_cname("k", lab)))
    return det.groupBy(*keys, "track_identifier", F.col("object_type").alias("raw_type")).agg(*aggs)


def merged_raw(states: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """States of (``keys``, track, raw type) from several states each: counts and sums add up, masks are joined."""
    how = {"sp_max": F.max, "hour_mask": F.bit_or}
    own = [*keys, "track_identifier", "raw_type"]
    counts = track_raw_columns()
    return states.groupBy(*own).agg(*[how.get(c, F.sum)(c).alias(c) for c in counts])


def track_raw_columns() -> list[str]:
    """The columns of a raw state."""
    plain = ["sp_sum", "sp_cnt", "sp_max", "hsp_sum", "hsp_cnt", "h_rows", "hour_mask"]
    return [*plain, *[_cname("c", lab) for lab in COMPASS_CATS], *[_cname("k", lab) for lab in CARDINAL_LABELS]]


def track_rollup(det: DataFrame) -> DataFrame:
    return folded_raw(track_raw_rollup(det))


def folded_raw(per_raw: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The second step: raw types folded into one row per (``keys``, track)."""
    raw = F.col("raw_type")
    small = F.coalesce(raw == RAW_SMALL, F.lit(False))
    large = F.coalesce(raw == RAW_LARGE, F.lit(False))
    # best 4-way direction within one raw type, as a packed score
    best_card = F.when(
        F.col("h_rows") > 0,
        argmax_score({lab: _cname("k", lab) for lab in CARDINAL_LABELS}, CARDINAL_LABELS),
    )
    per_raw = per_raw.withColumn("best_card", best_card)

    aggs = [
        F.bool_or(small).alias("has_small"),
        F.bool_or(large).alias("has_large"),
        F.sum("sp_sum").alias("sp_sum_all"),
        F.sum("sp_cnt").alias("sp_cnt_all"),
        F.max("sp_max").alias("sp_max_all"),
        F.bit_or("hour_mask").alias("hour_mask"),
        F.sum("h_rows").alias("h_rows"),
        F.max(F.when(small, F.col("best_card"))).alias("ped_card"),
        F.max(F.when(~small, F.col("best_card"))).alias("veh_card"),
    ]
    for cls, cond in (("small", small), ("large", large)):
        aggs += [
            F.sum(F.when(cond, F.col("sp_sum"))).alias(f"sp_sum_{cls}"),
            F.sum(F.when(cond, F.col("sp_cnt"))).alias(f"sp_cnt_{cls}"),
            F.max(F.when(cond, F.col("sp_max"))).alias(f"sp_max_{cls}"),
        ]
    for cls, cond in (("ped", small), ("veh", ~small)):
        aggs += [
            F.sum(F.when(cond, F.col("hsp_sum"))).alias(f"{cls}_hsp_sum"),
            F.sum(F.when(cond, F.col("hsp_cnt"))).alias(f"{cls}_hsp_cnt"),
            F.sum(F.when(cond, F.col("h_rows"))).alias(f"{cls}_h_rows"),
        ]
        for lab in COMPASS_CATS:
            aggs.append(F.sum(F.when(cond, F.col(_cname("c", lab)))).alias(_cname(f"{cls}_c", lab)))
    per_track = per_raw.groupBy(*keys, "track_identifier").agg(*aggs)
    # all rows = pedestrian rows + the rest, so the track's own counts are sums
    per_track = per_track.select(
        "*",
        *[
            (F.coalesce(F.col(_cname("ped_c", lab)), F.lit(0)) + F.coalesce(F.col(_cname("veh_c", lab)), F.lit(0)))
            .alias(_cname("c", lab))
            for lab in COMPASS_CATS
        ],
    )

    def dominant(prefix: str) -> Column:
        return argmax_score(
            {lab: f"coalesce({_cname(prefix, lab)}, 0)" for lab in COMPASS_CATS}, COMPASS_CATS
        )

    # scores first (one expression each), decoded in the next projection
    scored = per_track.select(
        "*",
        F.when(F.col("h_rows") > 0, dominant("c")).alias("_dom"),
        *[F.when(F.col(f"{c}_h_rows") > 0, dominant(f"{c}_c")).alias(f"_{c}_dom") for c in ("ped", "veh")],
    )
    return scored.select(
        *keys,
        "track_identifier",
        "has_small",
        "has_large",
        *[f"sp_{m}_{c}" for c in ("all", "small", "large") for m in ("sum", "cnt", "max")],
        "hour_mask",
        (F.col("h_rows") > 0).alias("has_heading"),
        score_label(F.col("_dom"), COMPASS_CATS).alias("dom_compass"),
        score_count(F.col("_dom"), COMPASS_CATS).alias("dom_count"),
        score_label(F.col("ped_card"), CARDINAL_LABELS).alias("ped_card"),
        score_label(F.col("veh_card"), CARDINAL_LABELS).alias("veh_card"),
        *[
            x
            for cls in ("ped", "veh")
            for x in (
                score_label(F.col(f"_{cls}_dom"), COMPASS_CATS).alias(f"{cls}_rose_dir"),
                F.try_divide(F.col(f"{cls}_hsp_sum"), F.col(f"{cls}_hsp_cnt")).alias(f"{cls}_rose_speed"),
                F.coalesce(F.col(f"{cls}_h_rows") > 0, F.lit(False)).alias(f"{cls}_has_heading"),
            )
        ],
    )


def track_zones(det: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (``keys``, track, zone) under the loader parse rule.

    Distinct (track, raw text) pairs are found first with a hash
    aggregate (a track repeats a handful of zone strings), and only those
    are parsed and exploded.  A NULL track id stays one group.
    """
    raw = (
        det.where(has_zones(F.col("zones_hit")))
        .select(*keys, "track_identifier", "zones_hit")
        .distinct()
    )
    return raw.select(*keys, "track_identifier", F.explode(zones_loader(F.col("zones_hit"))).alias("zone")).distinct()
