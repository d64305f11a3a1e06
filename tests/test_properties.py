"""Property test: the chunked previous-row operator equals a plain lag."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.operators.tracks import with_previous

BASE = datetime(2024, 1, 8)

row = st.tuples(
    st.sampled_from(["a", "b", "", None]),
    st.integers(min_value=0, max_value=40),  # seconds after BASE (duplicates likely)
    st.one_of(st.none(), st.floats(min_value=-2, max_value=2, allow_nan=False)),
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=30), chunk_s=st.integers(min_value=1, max_value=50))
def test_with_previous_matches_lag(spark, rows, chunk_s):
    data = [(i, t, BASE + timedelta(seconds=s), lon) for i, (t, s, lon) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, track_identifier string, timestamp timestamp_ntz, lon double")
    chunk = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / F.lit(chunk_s)).cast("long")
    got = {
        r.event_id: r.prev_lon
        for r in with_previous(df, chunk, ["lon"]).select("event_id", "prev_lon").collect()
    }
    pdf = pd.DataFrame(data, columns=["event_id", "track", "ts", "lon"])
    pdf["key"] = pdf["track"].fillna("<null-track>")
    pdf = pdf.sort_values(["key", "ts", "event_id"])
    pdf["prev"] = pdf.groupby("key")["lon"].shift(1)
    want = {int(e): (None if pd.isna(p) else float(p)) for e, p in zip(pdf["event_id"], pdf["prev"])}
    assert got == want
