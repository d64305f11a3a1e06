"""Raw detection schema, tenant table resolution and the typed projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.functions.casting import safe_double
from tracklens.functions.timefn import from_epoch_us, is_ntz
from tracklens.params import validate_slug

RAW_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("track_identifier", T.StringType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("device_identifier", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("longitude", T.StringType()),
        T.StructField("latitude", T.StringType()),
        T.StructField("speed", T.StringType()),
        T.StructField("heading_degrees", T.StringType()),
        T.StructField("zones_hit", T.StringType()),
    ]
)

# --- fixed value: tenants whose table name differs from their slug ---
TABLE_NAME_OVERRIDES = {"pip": "fif"}
# ---------------------------------------------------------------------


def table_name(org: str, overrides: dict[str, str] | None = None) -> str:
    validate_slug(org)
    return (overrides if overrides is not None else TABLE_NAME_OVERRIDES).get(org, org)


def quoted(*parts: str) -> str:
    """A table name whose parts may hold any character (a slug may hold hyphens)."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in parts)


def tenant_detections(
    spark: SparkSession,
    org: str,
    *,
    database: str | None = None,
    root: str | None = None,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """Scan one tenant's detections: a catalog table, or parquet under ``root``."""
    name = table_name(org, overrides)
    if root is not None:
        return spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return spark.table(quoted(*database.split("."), name) if database else quoted(name))


def store_tenant(raw: DataFrame, org: str, database: str, path: str) -> str:
    """Store a tenant's detections by UTC day under ``path`` and name them in the catalog; the table's name."""
    spark, name = raw.sparkSession, quoted(database, table_name(org))
    ts = F.col("timestamp")
    day = F.to_date(ts if is_ntz(raw, "timestamp") else from_epoch_us(F.unix_micros(ts), True))
    raw.withColumn("date", day).write.partitionBy("date").parquet(path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
    spark.catalog.createTable(name, path=path, source="parquet")
    spark.catalog.recoverPartitions(name)
    return name


def normalise(raw: DataFrame) -> DataFrame:
    """Typed view of raw detections; parse every text column once.

    Keeps the raw ``object_type``, ``heading_degrees`` and ``zones_hit``
    (several rules look at the raw text) and adds ``lon``, ``lat``,
    ``speed_ms`` and ``heading``.  ``timestamp`` becomes UTC wall-clock time
    (TIMESTAMP_NTZ), so that no session time zone enters anything behind
    this point; filter the period on the raw column first, which keeps the
    predicate in the scan.  ``event_id`` is only a tiebreak for rows with
    equal timestamps; without such a column it is a hash of the row, which
    orders rows the same way on every run.
    """
    ts = F.col("timestamp")
    event_id = F.col("event_id") if "event_id" in raw.columns else F.xxhash64(*[F.col(f.name) for f in RAW_SCHEMA if f.name in raw.columns])
    return raw.select(
        event_id.alias("event_id"),
        F.col("track_identifier"),
        F.col("object_type"),
        F.col("device_identifier"),
        (ts if is_ntz(raw, "timestamp") else from_epoch_us(F.unix_micros(ts), True)).alias("timestamp"),
        safe_double(F.col("longitude")).alias("lon"),
        safe_double(F.col("latitude")).alias("lat"),
        safe_double(F.col("speed")).alias("speed_ms"),
        F.col("heading_degrees"),
        safe_double(F.col("heading_degrees")).alias("heading"),
        F.col("zones_hit"),
    )
