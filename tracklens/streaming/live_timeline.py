"""Live five-minute timeline over a detection stream.

The batch timeline bins are epoch-aligned five-minute windows, which is
exactly what ``window(ts, '5 minutes')`` produces, so the stream shares the
class rule and gives the batch numbers for every closed window.  Event
time must be a TIMESTAMP (watermarks reject TIMESTAMP_NTZ), read as UTC.
In append mode a window is emitted once the watermark passes its end, so
the newest open window is held back until later data arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.classes import type_total
from tracklens.params import TIMELINE_BIN_MINUTES


def live_timeline(
    stream: DataFrame, watermark: str = "10 minutes", bin_minutes: int = TIMELINE_BIN_MINUTES
) -> DataFrame:
    """bin_start, object_type, count from a stream of raw detections."""
    s = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        s.withWatermark("timestamp", watermark)
        .groupBy(
            F.window("timestamp", f"{bin_minutes} minutes").alias("w"),
            type_total(F.col("object_type")).alias("object_type"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("bin_start"), "object_type", "count")
    )


def start_live_timeline(
    stream: DataFrame, sink_path: str, checkpoint: str, trigger: dict | None = None, **kw
):
    """Append closed windows to a Parquet folder (exactly once via the
    checkpoint, which must live on shared storage on a cluster).

    ``trigger`` is passed to ``DataStreamWriter.trigger`` (for example
    ``{"availableNow": True}`` for a catch-up run, or
    ``{"processingTime": "1 minute"}``).
    """
    writer = (
        live_timeline(stream, **kw)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
