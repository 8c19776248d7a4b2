"""Windows over timed rows; the same for tables and, with a watermark, for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as an instant, and a watermark if late is given."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, *keys: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, keys, n and total of value, for each window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    own = timed(events, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """start, end, key and n of runs of rows that lie less than gap apart."""
    own = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
