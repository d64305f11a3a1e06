"""Results of many tenants and periods from one scan, and their partitioned publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_up, to_mph
from tracklens.functions.classes import type_total
from tracklens.functions.timefn import floor_to, is_ntz
from tracklens.functions.zones import has_zones, zones_sql
from tracklens.operators import summary as S
from tracklens.operators.rollup import folded_raw, merged_raw, track_raw_rollup, track_zones
from tracklens.operators.segments import PERIOD, SEGMENT, cover, to_periods, with_segment
from tracklens.params import FREIGHT_ZONE, TIMELINE_BIN_MINUTES
from tracklens.plans.report import summary_aggs, summary_columns
from tracklens.session import scratch_dir, stage_table, unstage
from tracklens.sources.orgs import org_registry, with_org_name


class PeriodReports:
    """Results per (tenant, period) over ``det(org, ...)``, normalised detections with their tenant.

    Each result aggregates the rows once per segment and merges the segments'
    states, so overlapping periods cost states, not rows.  With ``hold`` the
    assigned rows are staged once in the shared folder for all results, until
    :meth:`close`; without it a result is one plan from the source.  Rows
    without a tenant or a time belong to no period.
    """

    def __init__(self, det: DataFrame, periods: DataFrame, hold: bool = True):
        def table(df: DataFrame, name: str) -> DataFrame:
            return stage_table(df, name, scratch_dir(det.sparkSession)) if hold else df

        self.periods = table(periods, "periods")
        self.held = table(cover(self.periods), "segments")
        self.rows = table(with_segment(det, self.held), "rows")

    def close(self) -> None:
        for df in (self.rows, self.held, self.periods):
            unstage(df)

    def summary(self, zone: str = FREIGHT_ZONE) -> DataFrame:
        """The summary's flat row of every period, those without any detection included."""
        raw = to_periods(track_raw_rollup(self.rows, SEGMENT), self.held)
        agg = folded_raw(merged_raw(raw, PERIOD), PERIOD).groupBy(*PERIOD).agg(*summary_aggs())
        entries = to_periods(track_zones(self.rows, SEGMENT), self.held).distinct()
        figures = entries.groupBy(*PERIOD).agg(
            F.count_distinct("zone").alias("zones_active"), F.count_if(F.col("zone") == zone).alias("freight_entries")
        )
        wide = self.periods.join(agg, list(PERIOD), "left").join(figures, list(PERIOD), "left")
        counted = [c for c in wide.columns if c.endswith("_count") or c.startswith("dir") or c in ("total_detections", "zones_active", "freight_entries")]
        wide = wide.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counted}).withColumn("_best", S._best_hour())
        flat = wide.select(
            *summary_columns(F.col("hours"), F.col("freight_entries"), F.col("zones_active")),
            "period_start",
            "period_end",
            F.col("org").alias("org_subdomain"),
        )
        return with_org_name(flat, "org_subdomain", org_registry(flat.sparkSession))

    def timeline(self, bin_minutes: int = TIMELINE_BIN_MINUTES) -> DataFrame:
        """Five-minute bins per period; a bin that a period's bound divides counts the period's own rows."""
        start = floor_to(F.col("timestamp"), is_ntz(self.rows, "timestamp"), bin_minutes * 60_000_000)
        keys = [start.alias("bin_start"), type_total(F.col("object_type")).alias("object_type")]
        states = self.rows.groupBy(*SEGMENT, *keys).agg(F.count(F.lit(1)).alias("n"))
        return to_periods(states, self.held).groupBy(*PERIOD, "bin_start", "object_type").agg(F.sum("n").alias("count"))

    def speed_profile(self) -> DataFrame:
        """Mean speed per track and class of every period."""
        keys = [F.col("track_identifier").alias("track_id"), type_total(F.col("object_type")).alias("object_type")]
        states = self.rows.groupBy(*SEGMENT, *keys).agg(F.sum("speed_ms").alias("s"), F.count("speed_ms").alias("n"))
        merged = to_periods(states, self.held).groupBy(*PERIOD, "track_id", "object_type")
        speed = to_mph(F.try_divide(F.sum("s"), F.sum("n")))
        return merged.agg(round_half_up(speed, 1).alias("avg_speed"))

    def zone_stats(self) -> DataFrame:
        """Zone statistics of every period."""
        listed = self.rows.where(has_zones(F.col("zones_hit"))).select(
            *SEGMENT, type_total(F.col("object_type")).alias("object_type"), to_mph(F.col("speed_ms")).alias("mph"),
            F.explode(zones_sql(F.col("zones_hit"))).alias("zone"),
        )
        states = listed.groupBy(*SEGMENT, "zone", "object_type").agg(
            F.count(F.lit(1)).alias("d"), F.sum("mph").alias("s"), F.count("mph").alias("n")
        )
        merged = to_periods(states, self.held).groupBy(*PERIOD, "zone", "object_type")
        return merged.agg(
            F.sum("d").alias("detections"),
            round_half_up(F.try_divide(F.sum("s"), F.sum("n")), 1).alias("avg_speed"),
            round_half_up(F.sum("s"), 1).alias("speed_sum"),
        )

    def publish(self, out_root: str, fmt: str = "parquet") -> dict[str, str]:
        """All results under ``out_root``, each in folders by tenant and period; a folder that exists is an error."""
        results = {
            "summary": self.summary().withColumn("org", F.col("org_subdomain")),
            "timeline": self.timeline(),
            "speed-profile": self.speed_profile(),
            "zone-stats": self.zone_stats(),
        }
        slug = F.concat(F.substring("period_start", 1, 10), F.lit("_to_"), F.substring("period_end", 1, 10))
        for name, df in results.items():
            out = df.withColumn("period", slug)
            out.write.mode("errorifexists").partitionBy("org", "period").format(fmt).save(f"{out_root.rstrip('/')}/{name}")
        return {name: f"{out_root.rstrip('/')}/{name}" for name in results}
