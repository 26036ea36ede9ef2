"""Structured streaming with windows: interval summaries with late data. Keyed processors are in processors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .processors import assemble_stream, bucket_stream

__all__ = ["assemble_stream", "bucket_stream", "interval_stream"]


def interval_stream(events: DataFrame, by: list[str], ts: str, value: str, width: str, lateness: str) -> DataFrame:
    """n, low and high per key and tumbling window, emitted once the watermark passes; later rows are dropped."""
    w = events.withWatermark(ts, lateness).groupBy(*by, F.window(ts, width))
    return w.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).select(*by, F.col("window.start").alias("start"), "n", "low", "high")
