"""Structured Streaming forms of the histogram and the burst flag (an extension; there is no stream in the batch API)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_histogram(events: DataFrame, ts_col: str, grain: str = "1 hour", late: str = "10 minutes", source_col: str | None = None) -> DataFrame:
    """Counts per window; rows later than the watermark are dropped, as a stream has to end its windows."""
    keys = [F.window(ts_col, grain).alias("w"), *([F.col(source_col).alias("source")] if source_col else [])]
    counted = events.withWatermark(ts_col, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), *([F.col("source")] if source_col else []), "n")


def stream_bursts(events: DataFrame, ts_col: str, baseline: float, multiplier: float = 5, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windows over a baseline that a batch run has measured."""
    return stream_histogram(events, ts_col, window, late).where(F.col("n") > multiplier * max(1.0, baseline))
