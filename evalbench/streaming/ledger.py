"""The usage ledger as a stream: windowed totals with a watermark, and the newest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and cost by window and operation; works on a batch or a stream of (ts, operation, cost)."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "operation")
    return g.agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost")).select(F.col("window.start").alias("start"), "operation", "calls", "cost")


def once(events: DataFrame, key: str = "usage_id", late: str = "10 minutes") -> DataFrame:
    """Each call once, if it comes again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint folder resumes it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
