"""Sliding event-time windows: the live form of the hop windows.

Window sums are additive, so a stream keeps one small state row per key and
open window; late data up to the watermark is included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.functions.scalar import score


def event_time(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Watermarks need a zoned timestamp; parquet may hold a zone-free one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) if watermark else df


def sliding_ratio(df: DataFrame, keys: list[str], ts: str, u: Column, w: Column, size: str, hop: str,
                  watermark: str | None = None) -> DataFrame:
    """sum(u*w) / sum(w*w) per key and sliding window, batch or streaming."""
    src = event_time(df, ts, watermark)
    agg = src.groupBy(*keys, F.window(ts, size, hop).alias("win")).agg(
        F.sum(u * w).alias("uw"), F.sum(w * w).alias("ww"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, F.col("win.start").alias("win_start"), F.col("win.end").alias("win_end"), "n",
                      (F.col("uw") / (F.col("ww") + 1e-12)).alias("est"))


def sliding_error(df: DataFrame, keys: list[str], ts: str, est: str, y: str, size: str, hop: str,
                  watermark: str | None = None) -> DataFrame:
    """Mean score per key and sliding window."""
    src = event_time(df, ts, watermark)
    agg = src.groupBy(*keys, F.window(ts, size, hop).alias("win")).agg(
        F.avg(score(F.col(est), F.col(y))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, F.col("win.end").alias("win_end"), "n", "mae")
