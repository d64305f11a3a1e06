"""The live timeline equals the batch timeline on every closed window."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracklens.operators.timeline import timeline
from tracklens.sources.detections import normalise
from tracklens.sources.events_view import detections_from_events
from tracklens.streaming.live_timeline import live_timeline


def test_live_timeline_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tracklens-stream-src-")
    raw = detections_from_events(spark, SF_SMALL).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    raw.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(raw.schema).parquet(src)
    q = (
        live_timeline(stream, watermark="0 seconds")
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("live_tl")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="tracklens-ckpt-"))
        .start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    live = {(str(r.bin_start), r.object_type, r["count"]) for r in spark.table("live_tl").collect()}
    batch = {(str(r.bin_start), r.object_type, r["count"])
             for r in timeline(normalise(raw)).collect()}
    last_bin = max(b for b, _, _ in batch)
    closed = {x for x in batch if x[0] != last_bin}
    assert live == closed


def test_live_timeline_parquet_sink(spark):
    from tracklens.streaming.live_timeline import start_live_timeline

    src = tempfile.mkdtemp(prefix="tracklens-stream-src2-")
    raw = detections_from_events(spark, SF_SMALL).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    raw.write.mode("overwrite").parquet(src)
    out = tempfile.mkdtemp(prefix="tracklens-stream-out-") + "/timeline"
    ckpt = tempfile.mkdtemp(prefix="tracklens-stream-ckpt-")
    stream = spark.readStream.schema(raw.schema).parquet(src)
    q = start_live_timeline(stream, out, ckpt, trigger={"availableNow": True}, watermark="0 seconds")
    q.awaitTermination(120)
    written = spark.read.parquet(out)
    total = written.agg(F.sum("count")).collect()[0][0]
    batch = timeline(normalise(raw))
    last_bin = batch.agg(F.max("bin_start")).collect()[0][0]
    expect = batch.where(F.col("bin_start") != last_bin).agg(F.sum("count")).collect()[0][0]
    assert total == expect
