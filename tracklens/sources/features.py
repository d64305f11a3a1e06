"""Geographic features (zones and sub-zones) of one tenant."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.functions.wkt import geojson_bounds, wkt_geojson
from tracklens.functions.zones import has_zones, zones_sql
from tracklens.params import validate_slug
from tracklens.sources.detections import quoted

# Shape numbers of well-known binary.
WKB_NAMES = {
    1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon",
    7: "GeometryCollection",
}

FEATURES_SCHEMA = T.StructType(
    [
        T.StructField("feature_id", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("geometry", T.StringType()),  # GeoJSON text
        T.StructField("metadata", T.StringType()),  # JSON object text
    ]
)


def features_table_name(org: str) -> str:
    validate_slug(org)
    return quoted(f"geo_info_{org}", "geographic_features")


def features_table(spark: SparkSession, org: str, name: str | None = None) -> DataFrame:
    """The tenant's feature table; a missing table gives an empty frame.

    Only "table does not exist" is absorbed; any other failure propagates.
    """
    fqn = name or features_table_name(org)
    if not spark.catalog.tableExists(fqn):
        return spark.createDataFrame([], FEATURES_SCHEMA)
    return as_features(spark.table(fqn))


def as_features(table: DataFrame) -> DataFrame:
    """A feature table as stored, in the form of ``FEATURES_SCHEMA``.

    Geometry may be GeoJSON text, well-known text or WKB (binary; either byte
    order), and metadata JSON text, a MAP, a struct or an array. Text that is
    neither and binary that is no WKB become NULL, so one bad feature spoils
    no report.
    """
    kind = {f.name: f.dataType for f in table.schema.fields}
    text = {n: F.col(n).cast("string") for n in ("feature_id", "feature_name", "feature_type")}
    geometry, metadata = F.col("geometry"), F.col("metadata")
    if isinstance(kind["geometry"], T.BinaryType):
        geometry = wkb_geojson(geometry)
    else:
        geometry = geometry.cast("string")
        geometry = F.when(F.try_parse_json(geometry).isNotNull(), geometry).otherwise(wkt_geojson(geometry))
    if isinstance(kind["metadata"], T.MapType | T.StructType | T.ArrayType):
        metadata = F.to_json(metadata)
    else:
        metadata = metadata.cast("string")
        metadata = F.when(F.try_parse_json(metadata).isNotNull(), metadata)
    return table.select(
        *[c.alias(n) for n, c in text.items()], geometry.alias("geometry"), metadata.alias("metadata")
    )


def _wkb_shape(data: bytes, at: int = 0) -> tuple[dict, int]:
    """One shape of well-known binary from position ``at``, and where it ends."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:  # a reference system number follows
        at += 4
    sizes = (code & 0x0FFFFFFF) // 1000
    width = 2 + bool(code & 0x80000000 or sizes in (1, 3)) + bool(code & 0x40000000 or sizes in (2, 3))
    name = WKB_NAMES[(code & 0x0FFFFFFF) % 1000]

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def point() -> list[float]:
        nonlocal at
        at += 8 * width
        return list(struct.unpack_from(f"{order}{width}d", data, at - 8 * width)[:2])

    def parts() -> list[dict]:
        nonlocal at
        found = []
        for _ in range(count()):
            shape, at = _wkb_shape(data, at)
            found.append(shape)
        return found

    if name == "Point":
        return {"type": name, "coordinates": point()}, at
    if name == "LineString":
        return {"type": name, "coordinates": [point() for _ in range(count())]}, at
    if name == "Polygon":
        return {"type": name, "coordinates": [[point() for _ in range(count())] for _ in range(count())]}, at
    if name == "GeometryCollection":
        return {"type": name, "geometries": parts()}, at
    return {"type": name, "coordinates": [p["coordinates"] for p in parts()]}, at


def wkb_to_geojson(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        shape, end = _wkb_shape(bytes(data))
    except (struct.error, IndexError, KeyError):
        return None
    return json.dumps(shape, separators=(",", ":")) if end == len(data) else None


def wkb_geojson(c: Column) -> Column:
    """GeoJSON text of well-known binary; NULL where it is none. Feature tables are site plans, and only
    those stored as binary pass through this function."""

    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(wkb_to_geojson, na_action="ignore")

    return convert(c)


def feature_bounds(features: DataFrame) -> DataFrame:
    """``feature_id, min_lon, min_lat, max_lon, max_lat`` of every feature with a position."""
    b = features.select("feature_id", *geojson_bounds(F.col("geometry")))
    return b.where(F.col("min_lon").isNotNull())


def _bbox_polygon(min_lon, min_lat, max_lon, max_lat):
    def pt(x, y):
        return F.format_string("[%.6f,%.6f]", x, y)

    ring = F.concat_ws(
        ",",
        pt(min_lon, min_lat),
        pt(max_lon, min_lat),
        pt(max_lon, max_lat),
        pt(min_lon, max_lat),
        pt(min_lon, min_lat),
    )
    poly = F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
    return F.when(min_lon.isNull() | min_lat.isNull(), F.lit(None).cast("string")).otherwise(poly)


def observed_zone_features(det: DataFrame) -> DataFrame:
    """Feature table derived from detections: the observed extent of each zone.

    One ``zone`` feature per zone name (bounding box of its detections,
    metadata = detection and track counts) and one ``subzone`` per
    (zone, device) without metadata.  Zones whose detections all lack
    coordinates get a NULL geometry.
    """
    z = det.where(has_zones(F.col("zones_hit"))).select(
        F.explode(zones_sql(F.col("zones_hit"))).alias("zone"),
        "device_identifier",
        "track_identifier",
        "lon",
        "lat",
    )

    def extent(n: Column) -> list[Column]:
        return [
            F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"),
            F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"), n.alias("n"),
        ]

    points = z.select("*", *[F.col(c).alias(f"{m}_{c}") for m in ("min", "max") for c in ("lon", "lat")])
    # one pass: per (zone, device, track), then each of these for its sub-zone and its zone
    small = points.groupBy("zone", "device_identifier", "track_identifier").agg(*extent(F.count(F.lit(1))))
    level = F.array(
        F.struct(F.lit(True).alias("sub"), F.col("device_identifier").alias("device")),
        F.struct(F.lit(False).alias("sub"), F.lit(None).cast("string").alias("device")),
    )
    both = small.select("*", F.inline(level))
    tracks = both.groupBy("zone", "sub", "device", "track_identifier").agg(*extent(F.sum("n")))
    whole = tracks.groupBy("zone", "sub", "device").agg(
        *extent(F.sum("n")), F.count("track_identifier").alias("tracks")
    )
    sub = F.col("sub")
    return whole.select(
        F.when(sub, F.concat(F.lit("subzone:"), F.col("zone"), F.lit(":"), F.col("device")))
        .otherwise(F.concat(F.lit("zone:"), F.col("zone")))
        .alias("feature_id"),
        F.when(sub, F.concat(F.col("zone"), F.lit("_"), F.col("device"))).otherwise(F.col("zone")).alias("feature_name"),
        F.when(sub, F.lit("subzone")).otherwise(F.lit("zone")).alias("feature_type"),
        _bbox_polygon(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")).alias("geometry"),
        F.when(~sub, F.format_string('{"detections":%d,"tracks":%d}', F.col("n"), F.col("tracks"))).alias("metadata"),
    )
