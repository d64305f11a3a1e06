"""Well-known text to GeoJSON, as column expressions.

The text is rewritten step by step: one blank between numbers, a position's
first two numbers in brackets, brackets for parentheses, numbers as JSON
writes them.  What comes out counts only if it parses as arrays of numbers
of the depth its type has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: type names and the depth of their coordinates ---
SHAPES = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}
COLLECTION = "GeometryCollection"
# -------------------------------------------------------------------
HEAD = r"^(?i)(?:SRID=\d+;)?\s*([A-Z]+)\s*(?:(?:ZM|Z|M)\b\s*)?"


def _numbers(c: Column) -> Column:
    """Numbers as JSON has them: no plus sign, no leading zeros, digits on both sides of a point."""
    c = F.regexp_replace(c, r"(?<=[\[,])\+", "")
    c = F.regexp_replace(c, r"(?<=[\[,])(-?)\.(?=\d)", "$10.")
    c = F.regexp_replace(c, r"(?<=\d)\.(?=[\],eE])", "")
    return F.regexp_replace(c, r"(?<=[\[,])(-?)0+(?=\d)", "$1")


def _arrays(c: Column, depth: int) -> Column:
    """``c`` is JSON of so many arrays of numbers in one another; every position has two."""
    parsed = F.from_json(c, "array<" * depth + "double" + ">" * depth)

    def whole(x: Column, level: int) -> Column:
        if level == 1:
            return (F.size(x) == 2) & F.forall(x, lambda n: n.isNotNull())
        return F.forall(x, lambda y: y.isNotNull() & F.coalesce(whole(y, level - 1), F.lit(False)))

    opened = F.length(F.regexp_replace(c, r"[^\[]", "")) == F.length(F.regexp_replace(c, r"[^\]]", ""))
    return F.coalesce(parsed.isNotNull() & whole(parsed, depth) & opened & ~c.contains("],]") & ~c.rlike(r"\]\["), F.lit(False))


def _shape(text: Column) -> Column:
    """GeoJSON of one shape that is no collection; NULL where it is none."""
    name = F.upper(F.regexp_extract(text, HEAD, 1))
    body = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, HEAD, "")), r"\s*([(),])\s*", "$1"), r"\s+", " ")
    inner = F.regexp_replace(body, r"(?<=[(,])\(([^(),]+)\)", "$1")  # points of a multi-point may have parentheses of their own
    out = F.lit(None).cast("string")
    for kind, depth in SHAPES.items():
        src = inner if kind == "MultiPoint" else body
        pairs = F.regexp_replace(src, r"([^(), ]+) ([^(), ]+)(?: [^(),]*)?", "[$1,$2]")
        nested = _numbers(F.translate(pairs, "()", "[]"))
        coords = F.regexp_extract(nested, r"^\[(\[[^\[\]]*\])\]$", 1) if kind == "Point" else nested
        json = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.when(F.upper(body) == "EMPTY", "[]").when(_arrays(coords, depth), coords), F.lit("}"))
        out = F.when(name == kind.upper(), json).otherwise(out)
    return out


def wkt_geojson(text: Column) -> Column:
    """GeoJSON text of well-known text, in two dimensions; NULL where it is none.

    All six plain types, empty ones and reference system prefixes included;
    heights and measures are left out.  The members of a collection are plain
    shapes: a collection within a collection is NULL.
    """
    text = F.trim(text)
    body = F.trim(F.regexp_replace(text, HEAD, ""))
    members = F.split(F.regexp_extract(body, r"(?s)^\((.*)\)$", 1), r",\s*(?=[A-Za-z])")
    shapes = F.transform(members, lambda m: _shape(F.trim(m)))
    listed = F.when(F.upper(body) == "EMPTY", F.lit("")).when(F.forall(shapes, lambda s: s.isNotNull()), F.array_join(shapes, ","))
    collection = F.concat(F.lit(f'{{"type":"{COLLECTION}","geometries":['), listed, F.lit("]}"))
    return F.when(F.upper(F.regexp_extract(text, HEAD, 1)) == COLLECTION.upper(), collection).otherwise(_shape(text))


def geojson_bounds(geometry: Column) -> list[Column]:
    """``min_lon, min_lat, max_lon, max_lat`` of all positions in a GeoJSON text; NULL without any."""
    position = r"\[\s*(-?[0-9][-+.0-9eE]*)\s*,\s*(-?[0-9][-+.0-9eE]*)"

    def numbers(group: int) -> Column:
        return F.transform(F.regexp_extract_all(geometry, F.lit(position), F.lit(group)), lambda x: x.try_cast("double"))

    return [
        how(numbers(group)).alias(f"{name}_{axis}")
        for name, how in (("min", F.array_min), ("max", F.array_max))
        for group, axis in ((1, "lon"), (2, "lat"))
    ]
