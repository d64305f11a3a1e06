"""Time arithmetic that works for TIMESTAMP and TIMESTAMP_NTZ columns.

Detection times are UTC; ``normalise`` turns them into TIMESTAMP_NTZ, and no
function here depends on the session's time zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def epoch_us(c: Column, ntz: bool) -> Column:
    """Microseconds since 1970-01-01 UTC.

    A TIMESTAMP_NTZ value is read as UTC wall-clock time from its date and
    time fields, so the session time zone (and its DST rules) never enters.
    """
    if ntz:
        seconds = F.extract(F.lit("SECOND"), c)  # decimal(8,6): seconds with micros
        return (
            F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (seconds * F.lit(1_000_000)).cast("long")
        )
    return F.unix_micros(c)


def epoch_ms(c: Column, ntz: bool) -> Column:
    """Whole milliseconds since the epoch (sub-millisecond part dropped)."""
    return F.floor(epoch_us(c, ntz) / F.lit(1000)).cast("long")


def from_epoch_us(us: Column, ntz: bool) -> Column:
    if ntz:
        return F.timestamp_add("MICROSECOND", us, F.expr(_NTZ_EPOCH))
    return F.timestamp_micros(us)


def floor_to(c: Column, ntz: bool, step_us: int) -> Column:
    """Start of the fixed-length bin (aligned to the epoch) holding ``c``.

    For 5-minute bins this equals truncating to the hour and adding
    5 * floor(minute / 5) minutes.
    """
    us = epoch_us(c, ntz)
    return F.timestamp_add("MICROSECOND", -F.pmod(us, F.lit(step_us)), c)


def ts_literal(value: datetime, ntz: bool) -> Column:
    """A UTC instant as a literal of the column's timestamp flavour."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if ntz:
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def iso8601(c: Column, ntz: bool) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00`` like Python's ``isoformat``, in UTC whatever the session's zone."""
    us = epoch_us(c, ntz)
    frac = F.pmod(us, F.lit(1_000_000))
    wall = (c if ntz else from_epoch_us(us, True)).cast("string")
    second = F.replace(F.substring(wall, 1, 19), F.lit(" "), F.lit("T"))
    part = F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(second, part, F.lit("+00:00"))
