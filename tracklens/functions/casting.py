"""Safe numeric parsing and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklens.params import MS_TO_MPH


def safe_double(c: Column) -> Column:
    """String -> double, NULL when the text is not a number.

    ``try_cast`` also accepts Java literal suffixes such as ``1.5d``; those
    are not numbers to a warehouse, so they become NULL first.  ``NaN`` and
    ``Infinity`` are left to the cast.
    """
    t = F.rtrim(c)
    suffixed = F.substring(t, -1, 1).isin("d", "D", "f", "F") & F.substring(t, -2, 1).isin(
        *"0123456789."
    )
    return F.when(suffixed, F.lit(None).cast("double")).otherwise(c.try_cast("double"))


def to_mph(c: Column) -> Column:
    return c * F.lit(MS_TO_MPH)


def round_half_up(c: Column, digits: int) -> Column:
    """SQL ``ROUND`` of a double: scale, round half away from zero, unscale.

    Plain IEEE arithmetic on the binary value, as warehouses evaluate
    ``ROUND(FLOAT64, n)``; Spark's own ``round`` rounds the shortest decimal
    text instead and disagrees at apparent ties (50.81005 -> 50.8101).
    NaN and infinities pass through.
    """
    scale = float(10**digits)
    scaled = F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)).cast("double")
    rounded = F.signum(c) * scaled / F.lit(scale)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(rounded)


def _split(c: Column) -> tuple[Column, Column]:
    """Two doubles of 26 bits each that add up to ``c``."""
    wide = c * F.lit(134217729.0)  # 2^27 + 1
    high = wide - (wide - c)
    return high, c - high


def _round_exact(c: Column, digits: int, ties_even: bool) -> Column:
    """``c`` to ``digits`` decimals by its exact binary value.

    ``x * 10^digits`` is taken as a double and its rounding error (both
    exact, by splitting the factors), so that a value just beside a tie is
    told from a tie.  The quotient of two exact doubles is then the double
    nearest to the decimal result, which is what parsing its text gives.
    """
    scale = 10.0**digits
    x = F.abs(c)
    product = x * F.lit(scale)
    (xh, xl), (sh, sl) = _split(x), _split(F.lit(scale))
    error = xl * sl - (((product - xh * sh) - xl * sh) - xh * sl)
    whole = F.floor(product).cast("double")
    part = product - whole
    on_tie = (whole % F.lit(2.0) == 1.0) if ties_even else F.lit(True)
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & on_tie)))
    rounded = F.signum(c) * (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    plain = F.isnan(c) | (x >= F.lit(2.0**52 / scale))  # nothing behind the point, or no number
    return F.when(plain, c).otherwise(rounded)


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Python ``round``: by the exact binary value, ties to even."""
    return _round_exact(c.cast("double"), digits, True)


def js_fixed(c: Column, digits: int) -> Column:
    """The number that JavaScript ``toFixed`` prints: by the exact binary value, ties away from zero."""
    return _round_exact(c.cast("double"), digits, False)


def js_round(c: Column) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5), as a long."""
    return F.floor(c + F.lit(0.5)).cast("long")


def fixed6(c: Column) -> Column:
    """Round to 6 decimals with plain IEEE arithmetic (engine independent)."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
