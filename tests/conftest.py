from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from tracklens.sources.detections import RAW_SCHEMA, normalise  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tracklens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tracklens-shared-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def raw_df(spark, rows):
    """Raw detections from dicts (missing keys are NULL); event_id = position."""
    names = RAW_SCHEMA.fieldNames()
    out = []
    for i, r in enumerate(rows):
        r = dict(r)
        r.setdefault("event_id", i)
        if isinstance(r.get("timestamp"), str):
            r["timestamp"] = ts(r["timestamp"])
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, RAW_SCHEMA)


def det_df(spark, rows):
    return normalise(raw_df(spark, rows))
