"""Object-type classification rules.

Three rules coexist in the reports and differ for NULL / unknown raw
types, so each has its own name:

* ``type_total``   small -> pedestrian, everything else (NULL too) -> vehicle
* ``type_partial`` small -> pedestrian, large -> vehicle, others unchanged
* exact matches ``== 'small'`` / ``== 'large'`` inside conditional aggregates
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
RAW_SMALL = "small"
RAW_LARGE = "large"
PEDESTRIAN = "pedestrian"
VEHICLE = "vehicle"
# --------------------


def type_total(raw: Column) -> Column:
    return F.when(raw == RAW_SMALL, F.lit(PEDESTRIAN)).otherwise(F.lit(VEHICLE))


def type_partial(raw: Column) -> Column:
    return (
        F.when(raw == RAW_SMALL, F.lit(PEDESTRIAN))
        .when(raw == RAW_LARGE, F.lit(VEHICLE))
        .otherwise(raw)
    )


def filter_key(choice: str) -> str | None:
    """Report filter 'All' / 'Pedestrian' / 'Vehicle' -> type value (None = all)."""
    if choice is None or choice.lower() == "all":
        return None
    return choice.lower()
