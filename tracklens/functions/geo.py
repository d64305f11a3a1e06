"""Geodesy as column expressions: step distance, projection, hex bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklens.params import EARTH_RADIUS_M


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    p1 = F.radians(lat1)
    p2 = F.radians(lat2)
    dp = F.radians(lat2 - lat1)
    dl = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    # clamp rounding overshoot; ``least`` would turn a NULL into 1.0
    a = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def mercator_xy(lon: Column, lat: Column, ref_lat: Column) -> tuple[Column, Column]:
    """Web-Mercator metres scaled to true metres at ``ref_lat``."""
    k = F.lit(EARTH_RADIUS_M) * F.cos(F.radians(ref_lat))
    x = k * F.radians(lon)
    y = k * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return x, y


def mercator_inverse(x: Column, y: Column, ref_lat: Column) -> tuple[Column, Column]:
    k = F.lit(EARTH_RADIUS_M) * F.cos(F.radians(ref_lat))
    lon = F.degrees(x / k)
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / k)) - F.lit(math.pi / 2))
    return lon, lat


def hex_cell(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """Pointy-top hexagon (column, row) whose centre is nearest to (x, y).

    Centres lie on two rectangular lattices: even rows at (i*w, 2k*h) and odd
    rows at ((i+0.5)*w, (2k+1)*h) with w = sqrt(3)*r and h = 1.5*r.  The
    nearer of the closest point of each lattice is the hexagon's centre
    (ties go to the even lattice).  Row = y / h, column = x / w - (row odd)/2.
    """
    w = math.sqrt(3.0) * radius
    h = 1.5 * radius

    def rnd(v: Column) -> Column:
        return F.floor(v + F.lit(0.5))

    ax = rnd(x / F.lit(w)) * F.lit(w)
    ay = rnd(y / F.lit(2 * h)) * F.lit(2 * h)
    bx = rnd((x - F.lit(w / 2)) / F.lit(w)) * F.lit(w) + F.lit(w / 2)
    by = rnd((y - F.lit(h)) / F.lit(2 * h)) * F.lit(2 * h) + F.lit(h)
    da = (x - ax) * (x - ax) + (y - ay) * (y - ay)
    db = (x - bx) * (x - bx) + (y - by) * (y - by)
    cx = F.when(db < da, bx).otherwise(ax)
    cy = F.when(db < da, by).otherwise(ay)
    row = rnd(cy / F.lit(h)).cast("long")
    col = rnd(cx / F.lit(w) - F.pmod(row, F.lit(2)).cast("double") / F.lit(2.0)).cast("long")
    return col, row


def hex_center(col: Column, row: Column, radius: float | Column) -> tuple[Column, Column]:
    w = math.sqrt(3.0) * radius
    h = 1.5 * radius
    cx = (col.cast("double") + F.pmod(row, F.lit(2)).cast("double") / F.lit(2.0)) * F.lit(w)
    cy = row.cast("double") * F.lit(h)
    return cx, cy
