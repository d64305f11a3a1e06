"""Many tenants and periods at once against the one-period results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, det_df
from tracklens.operators import segments as SG
from tracklens.operators.filters import period_filter
from tracklens.operators.rollup import track_rollup, track_zones
from tracklens.operators.speed import speed_profile
from tracklens.operators.timeline import timeline
from tracklens.operators.zonestats import zone_stats
from tracklens.params import Period
from tracklens.plans import report as RP
from tracklens.plans.periods import PeriodReports
from tracklens.sources.detections import normalise
from tracklens.sources.events_view import detections_from_events

PERIODS = [
    ("pip", Period("2024-01-08T00:00:00", "2024-01-08T23:59:59")),
    ("pip", Period("2024-01-08T00:00:00", "2024-01-15T00:00:00")),  # overlaps, ends inside the next one's first bin
    ("pip", Period("2024-01-10T07:31:07", "2024-01-10T19:02:30", end_inclusive=False)),
    ("pip", Period("2030-01-01T00:00:00", "2030-01-02T00:00:00")),  # nothing in it
    ("other", Period("2024-01-01T00:00:00", "2024-01-31T23:59:59")),
]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def det(spark):
    tenant = F.when(F.col("device_identifier") == "dev-0", "pip").when(F.col("device_identifier") == "dev-1", "other")
    return normalise(detections_from_events(spark, SF_SMALL)).withColumn("org", tenant)


@pytest.fixture(scope="module")
def reports(spark, det):
    out = PeriodReports(det, SG.period_table(spark, PERIODS))
    yield out
    out.close()


def of_one(df, org, period, org_col="org"):
    keep = (F.col(org_col) == org) & (F.col("period_start") == period.start) & (F.col("period_end") == period.end)
    return df.where(keep)


def test_every_period_equals_its_own_query(spark, det, reports):
    got = {"summary": reports.summary().persist()}
    got |= {"timeline": reports.timeline().persist(), "speed": reports.speed_profile().persist(), "zones": reports.zone_stats().persist()}
    assert got["summary"].count() == len(PERIODS)
    for org, period in PERIODS:
        own = period_filter(det.where(F.col("org") == org).drop("org"), period)
        assert rows(of_one(got["summary"], org, period, "org_subdomain")) == rows(
            RP.summary(track_rollup(own), track_zones(own), period, org, spark)
        )
        for name, plain in (("timeline", timeline), ("speed", speed_profile), ("zones", zone_stats)):
            mine = of_one(got[name], org, period).drop(*SG.PERIOD)
            assert rows(mine) == rows(plain(own)), (name, org, period)


def test_a_row_at_midnight_belongs_to_both_days(spark):
    det = det_df(spark, [{"track_identifier": "a", "timestamp": t} for t in ("2024-01-02T00:00:00", "2024-01-02T00:00:01", None)])
    det = det.withColumn("org", F.lit("x"))
    days = [("x", Period(f"2024-01-0{d}T00:00:00", f"2024-01-0{d + 1}T00:00:00")) for d in (1, 2)]
    tl = PeriodReports(det, SG.period_table(spark, days), hold=False).timeline()
    assert {(r.period_start[:10], r["count"]) for r in tl.collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}
    half = [(o, Period(p.start, p.end, end_inclusive=False)) for o, p in days]
    tl = PeriodReports(det, SG.period_table(spark, half), hold=False).timeline()
    assert {(r.period_start[:10], r["count"]) for r in tl.collect()} == {("2024-01-02", 2)}


def test_segments_of_overlapping_periods(spark):
    spans = [("x", Period("2024-01-01T00:00:00", "2024-01-04T00:00:00", False)), ("x", Period("2024-01-02T00:00:00", "2024-01-03T00:00:00", False))]
    held = SG.cover(SG.period_table(spark, spans))
    day = SG.SLOT_US
    first = 19723 * day  # 2024-01-01
    got = {((r.segment - first) // day, (r.until - first) // day, r.period_start[8:10]) for r in held.collect()}
    assert got == {(0, 1, "01"), (1, 2, "01"), (2, 3, "01"), (1, 2, "02")}


def test_days_and_weeks(spark):
    det = det_df(spark, [{"timestamp": t} for t in ("2024-01-01T10:00:00", "2024-01-07T10:00:00")]).withColumn("org", F.lit("x"))
    got = {(r.period_start, r.period_end, r.hours) for r in SG.days_and_weeks(det).collect()}
    day = 86399 / 3600
    assert got == {
        ("2024-01-01T00:00:00", "2024-01-01T23:59:59", day),
        ("2024-01-07T00:00:00", "2024-01-07T23:59:59", day),
        ("2024-01-01T00:00:00", "2024-01-08T00:00:00", 168.0),
    }


def test_publish_by_tenant_and_period(spark, reports, tmp_path):
    paths = reports.publish(str(tmp_path / "out"))
    tl = spark.read.parquet(paths["timeline"])
    assert {(r.org, r.period) for r in tl.select("org", "period").distinct().collect()} <= {
        (o, f"{p.start[:10]}_to_{p.end[:10]}") for o, p in PERIODS
    }
    one = tl.where("org = 'other'")
    assert one.agg(F.sum("count")).first()[0] == reports.timeline().where("org = 'other'").agg(F.sum("count")).first()[0]
    with pytest.raises(Exception, match="already exists"):
        reports.publish(str(tmp_path / "out"))


def test_a_tenant_table_is_read_by_the_days_of_the_periods(spark, tmp_path):
    import glob

    from tracklens.sources.detections import store_tenant, tenant_detections

    raw = detections_from_events(spark, SF_SMALL)
    path = str(tmp_path / "tenant")
    store_tenant(raw, "pip", "tenants_test", path)
    try:
        table = tenant_detections(spark, "pip", database="tenants_test")
        assert table.count() == raw.count()
        for day in ("2024-01-07", "2024-01-11"):  # files that no period needs can't be read any more
            for file in glob.glob(f"{path}/date={day}/part-*"):
                with open(file, "wb") as f:
                    f.write(b"broken")
        periods = SG.period_table(spark, [("pip", Period(f"2024-01-0{d}T00:00:00", f"2024-01-0{d}T23:59:59")) for d in (8, 9)])
        det = normalise(SG.days_of(table, periods, "date")).withColumn("org", F.lit("pip"))
        got = PeriodReports(det, periods, hold=False).timeline().drop(*SG.PERIOD)
        two = Period("2024-01-08T00:00:00", "2024-01-09T23:59:59")
        assert rows(got) == rows(timeline(normalise(period_filter(raw, two))))
        with pytest.raises(Exception, match="(?i)parquet|footer|FAILED_READ"):
            table.agg(F.max("longitude")).collect()
    finally:
        spark.sql("DROP DATABASE tenants_test CASCADE")
