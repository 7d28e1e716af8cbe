"""Timed events per window, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    out = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "calls", "total")


def stream_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same over a stream with a watermark: windows are final once no event can be that late."""
    return per_window(events.withWatermark("ts", late), width)
