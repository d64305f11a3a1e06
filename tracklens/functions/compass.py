"""Heading classification into compass sectors.

Sectors are half-open ``[lo, hi)``; north wraps around 0.  A NaN heading
is treated like a missing one (it would otherwise compare greater than
every number and land in the north sector).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: 8-way sectors (label, lower bound, upper bound) ---
COMPASS_8 = [
    ("NE", 22.5, 67.5),
    ("E", 67.5, 112.5),
    ("SE", 112.5, 157.5),
    ("S", 157.5, 202.5),
    ("SW", 202.5, 247.5),
    ("W", 247.5, 292.5),
    ("NW", 292.5, 337.5),
]
COMPASS_8_NORTH = ("N", 337.5, 22.5)  # >= 337.5 or < 22.5
COMPASS_LABELS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
# 4-way sectors; anything that is not North/East/South is West
CARDINAL_4 = [("East", 45.0, 135.0), ("South", 135.0, 225.0)]
CARDINAL_4_NORTH = ("North", 315.0, 45.0)
CARDINAL_DEFAULT = "West"
CARDINAL_LABELS = ["North", "South", "East", "West"]
# --------------------------------------------------------------------


def compass8(h: Column) -> Column:
    """8-way label for a parsed heading; NULL for NULL/NaN."""
    label, hi_from, lo_below = COMPASS_8_NORTH
    expr = F.when(F.isnan(h), F.lit(None).cast("string")).when(
        (h >= hi_from) | (h < lo_below), F.lit(label)
    )
    for name, lo, hi in COMPASS_8:
        expr = expr.when((h >= lo) & (h < hi), F.lit(name))
    return expr


def cardinal4(h: Column) -> Column:
    """4-way label; NULL, NaN and unparseable headings fall to West."""
    label, hi_from, lo_below = CARDINAL_4_NORTH
    expr = F.when(F.isnan(h), F.lit(CARDINAL_DEFAULT)).when(
        (h >= hi_from) | (h < lo_below), F.lit(label)
    )
    for name, lo, hi in CARDINAL_4:
        expr = expr.when((h >= lo) & (h < hi), F.lit(name))
    return expr.otherwise(F.lit(CARDINAL_DEFAULT))


def _tie_order(labels: list[str | None]) -> list[str | None]:
    """Deterministic tie order: labels ascending (byte order), NULL last."""
    named = sorted(lab for lab in labels if lab is not None)
    return named + ([None] if None in labels else [])


def argmax_score(counts: dict[str | None, str], labels: list[str | None]) -> Column:
    """Packed long ``count * B + (B - 1 - position)`` maximised over labels.

    ``counts`` maps each label (None = the NULL category) to a SQL
    expression of its count.  The largest score belongs to the largest
    count, ties going to the label first in tie order (ascending, NULL
    last).  Being a plain long it can be combined further with
    ``max``/``greatest`` inside hash aggregates.  Decode with
    :func:`score_label` / :func:`score_count`.  Built as one SQL expression
    (a single call into the JVM instead of one per operator).
    """
    order = _tie_order(labels)
    base = len(order)
    terms = [f"CAST({counts[lab]} AS BIGINT) * {base} + {base - 1 - i}" for i, lab in enumerate(order)]
    return F.expr(f"greatest({', '.join(terms)})")


def _sql_str(lab: str | None) -> str:
    return "CAST(NULL AS STRING)" if lab is None else "'" + lab.replace("'", "''") + "'"


def score_label(score: Column, labels: list[str | None]) -> Column:
    order = _tie_order(labels)
    base = len(order)
    names = ", ".join(_sql_str(lab) for lab in order)
    pos = F.lit(base) - F.pmod(score, F.lit(base))
    # explicit NULL guard: element_at with a NULL index must not pick an element
    return F.when(score.isNull(), F.lit(None).cast("string")).otherwise(
        F.element_at(F.expr(f"array({names})"), pos.cast("int"))
    )


def score_count(score: Column, labels: list[str | None]) -> Column:
    base = len(_tie_order(labels))
    return F.floor(score / F.lit(base)).cast("long")
