"""Event-time aggregates on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as an instant (streams accept no zone-less time) with its watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_counts(events: DataFrame, ts: str, keys: Sequence[str], delay: str, aggs: dict[str, Column]) -> DataFrame:
    """Tumbling days per key; late rows within the delay still count."""
    w = F.window(ts, "1 day")
    return _timed(events, ts, delay).groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.to_date("w.start").alias("d"), *keys, *aggs)


def sliding_sums(events: DataFrame, ts: str, keys: Sequence[str], length: str, slide: str, delay: str, aggs: dict[str, Column]) -> DataFrame:
    w = F.window(ts, length, slide)
    return _timed(events, ts, delay).groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(
        F.to_date("w.start").alias("start"), F.to_date("w.end").alias("end"), *keys, *aggs)


def sessions(events: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    w = F.session_window(ts, gap)
    return _timed(events, ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """First delivery of every key within the watermark."""
    return _timed(events, ts, delay).dropDuplicatesWithinWatermark(list(keys))

