"""Org registry: slug -> display name and table-name override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.sources.detections import TABLE_NAME_OVERRIDES

# --- fixed values: known tenants and their display names ---
ORG_DISPLAY_NAMES = {"pip": "Portsmouth International Port"}
# -----------------------------------------------------------

ORGS_SCHEMA = T.StructType(
    [
        T.StructField("slug", T.StringType(), False),
        T.StructField("display_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
    ]
)


def org_registry(spark: SparkSession) -> DataFrame:
    slugs = sorted(set(ORG_DISPLAY_NAMES) | set(TABLE_NAME_OVERRIDES))
    rows = [(s, ORG_DISPLAY_NAMES.get(s), TABLE_NAME_OVERRIDES.get(s)) for s in slugs]
    return spark.createDataFrame(rows, ORGS_SCHEMA)


def with_org_name(df: DataFrame, slug_col: str, registry: DataFrame, out: str = "org_name") -> DataFrame:
    """Left lookup of the display name; an unknown slug names itself.

    The planner broadcasts the registry by its measured size.
    """
    reg = registry.select(F.col("slug").alias("__slug"), F.col("display_name").alias("__name"))
    joined = df.join(reg, df[slug_col] == reg["__slug"], "left")
    return joined.withColumn(out, F.coalesce(F.col("__name"), F.col(slug_col))).drop("__slug", "__name")


def org_name_literal(slug: str) -> Column:
    return F.lit(ORG_DISPLAY_NAMES.get(slug, slug))
