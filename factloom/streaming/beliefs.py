"""Incremental votes over an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_votes(events: DataFrame, category: Column, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, category, cnt) with a watermark; works on a stream and on a table alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), category.alias("category")).agg(F.count(F.lit(1)).alias("cnt"))
