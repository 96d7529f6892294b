"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_ticks(ticks: DataFrame, bucket: Column, ticker: str = "ticker", value: str = "value", tie: str = "event_id") -> DataFrame:
    """One OHLCV bar per ticker and bucket, from positive values; first and last by (ts, tie).

    All fields are partial aggregates, so ticks are combined before the shuffle.
    """
    at = F.struct("ts", tie)
    g = ticks.where(F.col(value) > 0).groupBy(F.col(ticker).cast("string").alias("ticker"), bucket.alias("bar"))
    out = g.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.withColumnRenamed("bar", "ts")


def minutes(n: int) -> Column:
    """The start of the n-minute bucket of ts."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (60 * n)) * (60 * n))


def day() -> Column:
    return F.date_trunc("day", F.col("ts").cast("timestamp"))
