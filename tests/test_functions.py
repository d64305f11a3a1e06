"""Column functions: casting, classes, sectors, zones, rounding, geodesy."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tracklens.functions.casting import js_round, round_half_up, safe_double
from tracklens.functions.classes import type_partial, type_total
from tracklens.functions.compass import cardinal4, compass8
from tracklens.functions.geo import haversine_m, hex_cell, hex_center
from tracklens.functions.labels import zone_title
from tracklens.functions.timefn import floor_to, iso8601
from tracklens.functions.zones import has_zones, zones_loader, zones_sql

HEADINGS = [
    ("0", "N", "North"),
    ("22.4999", "N", "North"),
    ("22.5", "NE", "North"),
    ("45", "NE", "East"),
    ("67.5", "E", "East"),
    ("112.5", "SE", "East"),
    ("135", "SE", "South"),
    ("157.5", "S", "South"),
    ("202.5", "SW", "South"),
    ("225", "SW", "West"),
    ("247.5", "W", "West"),
    ("292.5", "NW", "West"),
    ("315", "NW", "North"),
    ("337.5", "N", "North"),
    ("359.9", "N", "North"),
    ("360", "N", "North"),
    ("-90", "N", "North"),
    ("NaN", None, "West"),
    ("bad", None, "West"),
    (None, None, "West"),
]


def test_sectors(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in HEADINGS], "h string")
    got = df.select(
        "h", compass8(safe_double(F.col("h"))).alias("c"), cardinal4(safe_double(F.col("h"))).alias("k")
    ).collect()
    assert [(r.h, r.c, r.k) for r in got] == HEADINGS


def test_safe_double(spark):
    vals = ["1.5", " 2 ", "bad", "n/a", None, "1.5d", "2f", "NaN", "-90", "1e3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(safe_double(F.col("v"))).collect()]
    assert got[:5] == [1.5, 2.0, None, None, None]
    assert got[5:7] == [None, None]
    assert math.isnan(got[7])
    assert got[8:] == [-90.0, 1000.0]


def test_type_rules(spark):
    df = spark.createDataFrame([("small",), ("large",), ("unknown",), (None,)], "t string")
    got = df.select(type_total(F.col("t")).alias("a"), type_partial(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [
        ("pedestrian", "pedestrian"),
        ("vehicle", "vehicle"),
        ("vehicle", "unknown"),
        ("vehicle", None),
    ]


ZONES = [
    (None, [], False, []),
    ("  ", [], False, []),
    (" freight_yard ", ["freight_yard"], True, ["freight_yard"]),
    ('["a","b"]', ["a", "b"], True, ["a", "b"]),
    ('["terminal_b"," gate_1 ",null]', ["terminal_b", " gate_1 "], True, ["terminal_b", "gate_1"]),
    ('["a","a"]', ["a", "a"], True, ["a", "a"]),
    ("[broken", ["[broken"], True, []),
    ("[]", [], True, []),
]


def test_zone_rules(spark):
    df = spark.createDataFrame([(z,) for z, *_ in ZONES], "z string")
    got = df.select(
        zones_loader(F.col("z")).alias("loader"), has_zones(F.col("z")).alias("has"), zones_sql(F.col("z")).alias("sql")
    ).collect()
    for (raw, loader, has, sql), r in zip(ZONES, got):
        assert r.loader == loader, raw
        assert r.has == has, raw
        if has:
            assert (r.sql or []) == sql, raw


def test_round_half_up_is_binary(spark):
    # 50.81005 is stored just below the tie, 1.08885 just above it
    df = spark.createDataFrame([(50.81005,), (-1.08885,), (2.5,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 4)).collect()]
    assert got[0] == 50.81 and got[1] == -1.0889
    assert math.isnan(got[3]) and got[4] is None
    assert df.select(round_half_up(F.col("x"), 0)).collect()[2][0] == 3.0
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (-0.5,)], "x double").select(js_round(F.col("x"))).collect()] == [1, 2, 0]


def test_iso_and_bins(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-08 10:07:59.5' AS a, TIMESTAMP_NTZ'2024-01-08 10:00:00' AS b"
    )
    r = df.select(
        iso8601(F.col("a"), True).alias("ia"),
        iso8601(F.col("b"), True).alias("ib"),
        floor_to(F.col("a"), True, 300_000_000).alias("bin"),
    ).collect()[0]
    assert r.ia == "2024-01-08T10:07:59.500000+00:00"
    assert r.ib == "2024-01-08T10:00:00+00:00"
    assert str(r.bin) == "2024-01-08 10:05:00"


def test_title_words(spark):
    df = spark.createDataFrame([("freight_yard 2b",), ("gate_1",), ("ÉCOLE_x",)], "z string")
    got = [r[0] for r in df.select(zone_title(F.col("z"))).collect()]
    assert got[0] == "Freight Yard 2b"
    assert got[1] == "Gate 1"


def test_haversine_one_degree_latitude(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    d = df.select(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()[0][0]
    assert d == pytest.approx(6371010.0 * math.pi / 180, rel=1e-12)


def test_hex_cell_is_nearest_centre(spark):
    import random

    rnd = random.Random(7)
    pts = [(rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for _ in range(500)]
    r = 10.0
    df = spark.createDataFrame(pts, "x double, y double")
    col, row = hex_cell(F.col("x"), F.col("y"), r)
    cx, cy = hex_center(col, row, r)
    got = df.select("x", "y", cx.alias("cx"), cy.alias("cy")).collect()
    w, h = math.sqrt(3) * r, 1.5 * r
    for g in got:
        d0 = math.hypot(g.x - g.cx, g.y - g.cy)
        assert d0 <= r + 1e-9  # inside the circumscribed circle
        # no lattice centre nearby is closer
        j0 = round(g.y / h)
        for j in range(j0 - 2, j0 + 3):
            off = (j % 2) / 2
            i0 = round(g.x / w - off)
            for i in range(i0 - 2, i0 + 3):
                d = math.hypot(g.x - (i + off) * w, g.y - j * h)
                assert d0 <= d + 1e-9


def test_argmax_score_ties_and_nulls(spark):
    from tracklens.functions.compass import CARDINAL_LABELS, argmax_score, score_count, score_label

    df = spark.createDataFrame(
        [(2, 0, 2, 0), (0, 0, 0, 1), (None, None, None, None), (0, 3, 3, 3)],
        "k_North long, k_South long, k_East long, k_West long",
    )
    s = argmax_score({lab: f"k_{lab}" for lab in CARDINAL_LABELS}, CARDINAL_LABELS)
    got = df.select(score_label(s, CARDINAL_LABELS).alias("l"), score_count(s, CARDINAL_LABELS).alias("n")).collect()
    assert [(r.l, r.n) for r in got] == [("East", 2), ("West", 1), (None, None), ("East", 3)]


def test_rounding_goes_by_the_exact_value(spark):
    """Python's round and JavaScript's toFixed, at and beside ties."""
    from decimal import ROUND_HALF_UP, Decimal

    from tracklens.functions.casting import js_fixed, round_half_even

    values = [50.812335, 50.812325, 2.675, 1.45, 0.25, 0.35, 0.5, 1.5, 2.5, -2.675, -0.25, -1.45, 0.0, 1e15, 4.35, 1.005]
    values += [50.81 + i * 1e-6 for i in range(0, 4000, 7)] + [-1.09 + i * 5e-6 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    cols = [round_half_even(F.col("x"), 5).alias("p5"), round_half_even(F.col("x"), 1).alias("p1")]
    cols += [round_half_even(F.col("x"), 0).alias("p0"), js_fixed(F.col("x"), 1).alias("j1")]
    for r in df.select("x", *cols).collect():
        assert (r.p5, r.p1, r.p0) == (round(r.x, 5), round(r.x, 1), round(r.x, 0)), r.x
        # toFixed: the nearest multiple to the exact value, of two the one further from zero
        assert r.j1 == float(Decimal(r.x).quantize(Decimal("0.1"), ROUND_HALF_UP)), r.x
    odd = df.limit(1).select(round_half_even(F.lit(float("nan")), 1).alias("n"), round_half_even(F.lit(None).cast("double"), 1).alias("z")).first()
    assert odd.n != odd.n and odd.z is None


def test_zone_json_is_strict(spark):
    from tracklens.functions.zones import zones_loader, zones_sql

    texts = ["['a','b']", '["a"] junk', '["a"],["b"]', '["a"', '["a","b"]', " [] ", '["a", null, " "]', "bare", '["a"] ]']
    df = spark.createDataFrame([(x,) for x in texts], "z string")
    got = {r.z: (r.l, r.s) for r in df.select("z", zones_loader(F.col("z")).alias("l"), zones_sql(F.col("z")).alias("s")).collect()}
    for bad in ("['a','b']", '["a"] junk', '["a"],["b"]', '["a"', '["a"] ]'):
        assert got[bad] == ([bad], None) or got[bad] == ([bad], [])
    assert got['["a","b"]'] == (["a", "b"], ["a", "b"])
    assert got[" [] "] == ([], [])
    assert got['["a", null, " "]'] == (["a", " "], ["a"])
    assert got["bare"] == (["bare"], ["bare"])


def test_period_hours():
    from tracklens.params import Period

    assert Period("2024-01-08T00:00:00", "2024-01-08T12:00:00").hours() == 12
    assert Period("2024-01-08T00:00:00Z", "2024-01-08T12:30:00Z").hours() == 12.5
    assert Period("2024-01-08T00:00:00", "2024-01-08T00:10:00").hours() == 1
    for start, end in (
        ("2024-01-08T00:00:00Z", "2024-01-08T12:00:00"),
        ("2024-01-08T00:00:00+00:00", "2024-01-08T12:00:00+00:00"),
        ("2024-01-08", "2024-01-09"),
        ("2024-02-30T00:00:00", "2024-03-01T00:00:00"),
    ):
        assert Period(start, end).hours() == 24


def test_nan_coordinates_have_no_cell(spark):
    from conftest import det_df
    from tracklens.operators.heatmap import heatmap, unplaced_detections

    rows = [dict(track_identifier="t", timestamp="2024-01-08T10:00:00", longitude=x, latitude="50.8") for x in ("1.0", "NaN", "bad", None)]
    det = det_df(spark, rows)
    assert [r.lon for r in heatmap(det).collect()] == [1.0]
    assert unplaced_detections(det).first().points == 3

