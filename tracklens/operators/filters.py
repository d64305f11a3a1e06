"""Row predicates: reporting period and report type filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.classes import filter_key
from tracklens.functions.timefn import is_ntz, ts_literal
from tracklens.params import Period


def period_filter(det: DataFrame, period: Period, date_col: str | None = None) -> DataFrame:
    """``timestamp BETWEEN start AND end`` (end exclusive when asked).

    The bounds are literals of the column's own type, so the predicate is
    pushed into the Parquet scan.  ``date_col`` names a date partition
    column; a matching date range is added so whole partitions are pruned.
    """
    ntz = is_ntz(det, "timestamp")
    ts = F.col("timestamp")
    lo = ts_literal(period.start_dt, ntz)
    hi = ts_literal(period.end_dt, ntz)
    cond = (ts >= lo) & ((ts <= hi) if period.end_inclusive else (ts < hi))
    if date_col is not None:
        cond = cond & F.col(date_col).between(
            F.lit(period.start_dt.date()), F.lit(period.end_dt.date())
        )
    return det.where(cond)


def type_filter(df: DataFrame, choice: str, col: str = "object_type") -> DataFrame:
    """Report filter All / Pedestrian / Vehicle on any typed result."""
    key = filter_key(choice)
    return df if key is None else df.where(F.col(col) == key)
