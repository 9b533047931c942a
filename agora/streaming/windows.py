"""Event-time summaries, the same for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Event time as a timestamp with zone, which a watermark needs."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, size: str, *by: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
