"""Windowed metrics over a stream of predictions (assessed_at, domain, probability, latency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "10 minutes"


def timed(df: DataFrame, ts: str = "assessed_at", delay: str = DELAY) -> DataFrame:
    """Event time as an instant with a watermark; rows later than `delay` are dropped from
    windows that have been written."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _started(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *columns)


def prediction_counts(stream: DataFrame, size: str = "5 minutes", delay: str = DELAY) -> DataFrame:
    """Predictions per domain and tumbling window."""
    counted = timed(stream, delay=delay).groupBy(F.window("assessed_at", size), "domain").agg(
        F.count(F.lit(1)).alias("n"))
    return _started(counted, "domain", "n")


def high_stress_counts(stream: DataFrame, threshold: float = 0.5, size: str = "1 hour",
                       delay: str = DELAY) -> DataFrame:
    """High-stress flags per domain and hour, the series the surge rules compare."""
    return prediction_counts(stream.filter(F.col("probability") >= threshold), size, delay)


def latency_p99(stream: DataFrame, size: str = "5 minutes", delay: str = DELAY) -> DataFrame:
    """Approximate p99 latency per window with its severity; the sketch keeps state small."""
    p99 = F.percentile_approx("latency", F.lit(0.99), F.lit(10000))
    measured = timed(stream, delay=delay).groupBy(F.window("assessed_at", size)).agg(
        p99.alias("p99"), F.count(F.lit(1)).alias("n"))
    return _started(measured, "p99", "n").withColumn("severity", severity(F.col("p99")))


def severity(p99: Column) -> Column:
    return F.when(p99 > 2.0, "critical").when(p99 > 0.5, "warning").otherwise("ok")


def trailing_counts(stream: DataFrame, span: str = "1 hour", slide: str = "5 minutes",
                    delay: str = DELAY) -> DataFrame:
    """Count of the trailing span at every slide: the baseline of the volume rule."""
    counted = timed(stream, delay=delay).groupBy(F.window("assessed_at", span, slide), "domain").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), "domain", "n")


def session_durations(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes",
                      delay: str = DELAY) -> DataFrame:
    """Bursts of activity per key, closed by a gap."""
    sessions = timed(stream, delay=delay).groupBy(F.session_window("assessed_at", gap).alias("s"), key).agg(
        F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                           F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


def dedup_predictions(stream: DataFrame, key: str = "conversation_id", delay: str = "1 hour") -> DataFrame:
    """First row per conversation within the watermark; replays are harmless."""
    return timed(stream, delay=delay).dropDuplicatesWithinWatermark([key])
