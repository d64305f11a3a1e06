"""Detections derived from the driver's ``events`` table.

The test tables carry no sensor data, so a deterministic projection of
``events`` supplies every detection column, including the malformed values
the parsing rules must survive.  The same SQL text runs in Spark SQL and in
DuckDB (it is the leading CTE of every oracle query), so both engines see
identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One select list serves both engines: DuckDB runs it as SQL text (the
# leading CTE of every oracle query) and Spark evaluates the same
# expressions with ``selectExpr`` over the scanned events.
DETECTIONS_COLUMNS = [
    "event_id",
    "concat('trk-', CAST(user_id AS STRING)) AS track_identifier",
    """CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 199 = 0 THEN 'unknown'
       WHEN user_id % 3 = 0 THEN 'large' ELSE 'small' END AS object_type""",
    "concat('dev-', CAST(user_id % 4 AS STRING)) AS device_identifier",
    "ts AS timestamp",
    """CASE WHEN event_id % 103 = 0 THEN 'bad'
       ELSE CAST(CAST(-1090000 + (user_id % 5) * 310 + (event_id % 40) * 20 + event_id % 6 AS DOUBLE)
                 / CAST(1000000 AS DOUBLE) AS STRING) END AS longitude""",
    """CAST(CAST(50810000 + (user_id % 3) * 170 + (event_id % 7) * 10 + event_id % 6 AS DOUBLE)
       / CAST(1000000 AS DOUBLE) AS STRING) AS latitude""",
    """CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 107 = 0 THEN NULL
       ELSE CAST(value AS STRING) END AS speed""",
    """CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'bad'
       WHEN event_id % 79 = 0 THEN '-90' WHEN event_id % 73 = 0 THEN 'NaN'
       ELSE CAST((user_id * 53 + (event_id % 7) * 20) % 360 AS STRING) END AS heading_degrees""",
    """CASE WHEN event_id % 101 = 0 THEN '[broken' WHEN event_id % 109 = 0 THEN concat('[', chr(39), 'gate_2', chr(39), ']')
       WHEN event_id % 113 = 0 THEN '["gate_3"] junk' WHEN event_id % 127 = 0 THEN '["gate_4"],["gate_5"]'
       WHEN event_id % 6 = 0 THEN NULL
       WHEN event_id % 6 = 1 THEN '  ' WHEN event_id % 6 = 2 THEN ' freight_yard '
       WHEN event_id % 6 = 3 THEN '["terminal_a","freight_yard"]'
       WHEN event_id % 6 = 4 THEN '["terminal_b"," gate_1 ",null]'
       ELSE '["terminal_a","terminal_a"]' END AS zones_hit""",
]

DETECTIONS_SQL = "SELECT " + ",\n  ".join(DETECTIONS_COLUMNS) + "\nFROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def detections_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (string-typed) detections over the whole ``events`` table."""
    return events(spark, sf_dir).selectExpr(*DETECTIONS_COLUMNS)
