"""Many tenants and periods at once: rows are assigned to time segments, their states merged into periods.

Periods of one tenant may overlap in any way (days and weeks, or closed
periods that share their midnight rows).  All their bounds together cut time
into segments that no period divides, so a row belongs to exactly one
segment.  Aggregates are formed once per segment, whatever the number of
periods; a period's result is the merge of the states of its segments.

Rows find their segment, and segments their periods, by an equi-join on
tenant and day (``SLOT_US``) with the exact bounds as a condition behind it:
no row meets a segment of another day.  Times are microseconds; a period is
``[lo_us, hi_us)``, a closed end being one microsecond further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.functions.timefn import epoch_us, is_ntz
from tracklens.params import Period

SLOT_US = 86_400_000_000
PERIOD = ("org", "period_start", "period_end")
SEGMENT = ("org", "segment")


def period_table(spark: SparkSession, periods: list[tuple[str, Period]]) -> DataFrame:
    """``org, period_start, period_end, hours, lo_us, hi_us`` of named periods."""
    rows = [(org, p.start, p.end, float(p.hours()), p.start_dt, p.end_dt, p.end_inclusive) for org, p in periods]
    kinds = "org string, period_start string, period_end string, hours double, s timestamp_ntz, e timestamp_ntz, closed boolean"
    df = spark.createDataFrame(rows, kinds)
    us = epoch_us(F.col("s"), True), epoch_us(F.col("e"), True)
    return df.select(*PERIOD, "hours", us[0].alias("lo_us"), (us[1] + F.col("closed").cast("long")).alias("hi_us"))


def closed_periods(spans: DataFrame) -> DataFrame:
    """The same of ``spans(org, s, e)``: closed periods between two TIMESTAMP_NTZ columns."""
    lo, hi = epoch_us(F.col("s"), True), epoch_us(F.col("e"), True)
    hours = F.greatest(F.lit(1.0), (hi - lo) / F.lit(3_600_000_000.0))

    def text(c: str) -> Column:
        return F.replace(F.substring(F.col(c).cast("string"), 1, 19), F.lit(" "), F.lit("T"))

    return spans.select(
        "org", text("s").alias("period_start"), text("e").alias("period_end"), hours.alias("hours"), lo.alias("lo_us"),
        (hi + 1).alias("hi_us"),
    )


def days_and_weeks(det: DataFrame) -> DataFrame:
    """Closed periods of each tenant: every UTC day with detections, to its last second, and its week from midnight to midnight."""
    days = det.select("org", F.to_date("timestamp").alias("day")).distinct()
    day, week = F.col("day").cast("timestamp_ntz"), F.trunc("day", "week")
    daily = days.select("org", day.alias("s"), F.expr("CAST(day AS TIMESTAMP_NTZ) + INTERVAL '86399' SECOND").alias("e"))
    weekly = days.select("org", week.alias("w")).distinct()
    weekly = weekly.select("org", F.col("w").cast("timestamp_ntz").alias("s"), F.date_add("w", 7).cast("timestamp_ntz").alias("e"))
    return closed_periods(daily.union(weekly))


def _slots(lo: Column, hi: Column, slot_us: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / slot_us).cast("long"), F.floor((hi - 1) / slot_us).cast("long")))


def segments(periods: DataFrame) -> DataFrame:
    """``org, segment, until``: from ``segment`` to before ``until`` no period of the tenant starts or ends."""
    cuts = periods.where("lo_us < hi_us").select("org", F.explode(F.array("lo_us", "hi_us")).alias("segment")).distinct()
    ahead = F.lead("segment").over(Window.partitionBy("org").orderBy("segment"))
    return cuts.select("org", "segment", ahead.alias("until")).where("until IS NOT NULL")


def cover(periods: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """``org, segment, until`` and the period, for every period that holds the segment."""
    by_slot = periods.where("lo_us < hi_us").select(*PERIOD, "lo_us", "hi_us", _slots(F.col("lo_us"), F.col("hi_us"), slot_us).alias("slot"))
    seg = segments(periods).withColumn("slot", F.floor(F.col("segment") / slot_us).cast("long"))
    held = seg.join(by_slot, ["org", "slot"]).where("lo_us <= segment AND until <= hi_us")
    return held.select("org", "segment", "until", "period_start", "period_end")


def with_segment(det: DataFrame, held: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """The rows of ``det(org, timestamp, ...)`` that some period holds, with their ``segment``; ``held`` is a ``cover``."""
    seg = held.select(F.col("org").alias("_org"), "segment", "until").distinct()
    seg = seg.withColumn("_slot", _slots(F.col("segment"), F.col("until"), slot_us))
    us = epoch_us(F.col("timestamp"), is_ntz(det, "timestamp"))
    rows = det.withColumn("_us", us)
    at = (F.col("org") == F.col("_org")) & (F.floor(F.col("_us") / slot_us).cast("long") == F.col("_slot"))
    return rows.join(seg, at & (F.col("segment") <= F.col("_us")) & (F.col("_us") < F.col("until"))).select(*det.columns, "segment")


def to_periods(states: DataFrame, held: DataFrame) -> DataFrame:
    """States per segment as states per period: each comes once for every period that holds its segment."""
    return states.join(held.drop("until"), list(SEGMENT)).drop("segment")


def days_of(det: DataFrame, periods: DataFrame, date_col: str) -> DataFrame:
    """``det`` on the days between the first and the last of ``periods``.

    ``date_col`` is the date partition column of a stored table; the two days
    are scalar subqueries over the periods, so the scan lists and reads the
    folders between them only.
    """

    def day(us: Column) -> Column:
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / SLOT_US).cast("int"))

    first = periods.select(day(F.min("lo_us"))).scalar()
    last = periods.select(day(F.max(F.col("hi_us") - 1))).scalar()
    return det.where(F.col(date_col).between(first, last))
