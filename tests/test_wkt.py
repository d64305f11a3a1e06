"""Well-known text against the same shapes as GeoJSON."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracklens.functions.wkt import geojson_bounds, wkt_geojson

SHAPES = {
    "POINT(1 2)": ("Point", [1, 2]),
    "  point ( -1.5   50.25 ) ": ("Point", [-1.5, 50.25]),
    "SRID=4326;POINT(1e2 -.5)": ("Point", [100, -0.5]),
    "POINT Z (1 2 3)": ("Point", [1, 2]),
    "POINT ZM(+1. 007 3 4)": ("Point", [1, 7]),
    "POINT M (0 0.0 9)": ("Point", [0, 0]),
    "POINT EMPTY": ("Point", []),
    "LINESTRING(0 0, 1 1,2 0)": ("LineString", [[0, 0], [1, 1], [2, 0]]),
    "MULTIPOINT(1 2)": ("MultiPoint", [[1, 2]]),
    "MULTIPOINT(1 2, 3 4)": ("MultiPoint", [[1, 2], [3, 4]]),
    "MULTIPOINT((1 2), (3 4))": ("MultiPoint", [[1, 2], [3, 4]]),
    "POLYGON((0 0,1 0,1 1,0 0),\n(0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))": (
        "Polygon",
        [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]],
    ),
    "Polygon Empty": ("Polygon", []),
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))": ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]),
    "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))": ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]),
}
BROKEN = [
    None, "", "POINT", "POINT(1", "POINT 1 2", "POINT(1)", "POINT(1 2, 3 4)", "POINT((1 2))", "POINT(1 x)", "POINT(1 2))", "POINT(1 2) POINT(3 4)",
    "LINESTRING((0 0,1 1))", "LINESTRING(0 0,,1 1)", "LINESTRING(0 0,1 1,)", "POLYGON(0 0,1 1)", "POLYGON((0 0,1 1)(2 2,3 3))", "CIRCLE(0 0)",
    "MULTIPOLYGON((0 0,1 0,1 1,0 0))", "GEOMETRYCOLLECTION(POINT(1 2),LINE(1 2))", "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(1 2)))", "text",
]


@pytest.fixture(scope="module")
def got(spark):
    texts = [*SHAPES, *BROKEN, "GEOMETRYCOLLECTION EMPTY", "GeometryCollection(POINT(1 2), POLYGON((0 0,1 0,1 1,0 0)))"]
    df = spark.createDataFrame([(t,) for t in texts], "w string").select("w", wkt_geojson(F.col("w")).alias("g"))
    return {r.w: r.g for r in df.collect()}


@pytest.mark.parametrize("text", SHAPES)
def test_shapes(got, text):
    kind, coordinates = SHAPES[text]
    assert json.loads(got[text]) == {"type": kind, "coordinates": coordinates}


@pytest.mark.parametrize("text", BROKEN)
def test_what_is_no_shape(got, text):
    assert got[text] is None


def test_collections(got):
    assert json.loads(got["GEOMETRYCOLLECTION EMPTY"]) == {"type": "GeometryCollection", "geometries": []}
    both = json.loads(got["GeometryCollection(POINT(1 2), POLYGON((0 0,1 0,1 1,0 0)))"])
    assert [g["type"] for g in both["geometries"]] == ["Point", "Polygon"] and both["geometries"][0]["coordinates"] == [1, 2]


def test_long_rings_and_bounds(spark):
    ring = ", ".join(f"{i / 7:.4f} {-i / 3:.3f}" for i in range(50_000))
    df = spark.createDataFrame([(f"POLYGON(({ring}))",), ("POINT EMPTY",), (None,)], "w string")
    rows = df.select(wkt_geojson(F.col("w")).alias("g")).select("g", *geojson_bounds(F.col("g"))).collect()
    assert len(json.loads(rows[0].g)["coordinates"][0]) == 50_000
    assert tuple(rows[0])[1:] == (0.0, -16666.333, 7142.7143, 0.0)
    assert tuple(rows[1])[1:] == tuple(rows[2])[1:] == (None,) * 4
