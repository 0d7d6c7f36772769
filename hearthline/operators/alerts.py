"""Rates over time and the conditions on them, in batch.

Events are first reduced to one row per time bucket and key. Windows then run over bucket
rows, whose number depends on the time covered and not on the traffic, so a domain with a
third of all events costs no more than a quiet one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.order_stats import quantiles

MINUTE = 60
HOUR = 3600
WEEK = 604800


def epoch_second(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000000)


def bucket_start(ts: str, seconds: int) -> Column:
    second = epoch_second(ts)
    return second - F.pmod(second, F.lit(seconds))


def bucket_counts(df: DataFrame, seconds: int, keys: Sequence[str] = ("domain",),
                  ts: str = "assessed_at") -> DataFrame:
    """Events per key and time bucket; `bucket` is the start in epoch seconds."""
    return df.groupBy(*keys, bucket_start(ts, seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def with_empty_buckets(counts: DataFrame, seconds: int, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """`counts` with a row of 0 for every bucket without events, from a key's first bucket to
    the table's last one, so that an outage is a low count and not a missing row."""
    last = counts.agg(F.max("bucket").alias("last"))
    spans = counts.groupBy(*keys).agg(F.min("bucket").alias("first")).crossJoin(F.broadcast(last))  # one row
    every = spans.select(*keys, F.explode(F.sequence("first", "last", F.lit(seconds).cast("long"))).alias("bucket"))
    return every.join(counts, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def with_hold(series: DataFrame, hold: int, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Adds `alert`: firing now and in every bucket of the last `hold` seconds before."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    quiet = F.last(F.when(~F.col("firing"), F.col("bucket")), ignorenulls=True).over(order)
    first = F.min("bucket").over(Window.partitionBy(*keys))
    step = F.col("bucket") - F.lag("bucket").over(order)
    since = F.col("bucket") - F.coalesce(F.col("_quiet") + F.coalesce("_step", F.lit(0)), F.col("_first"))
    return series.withColumns({"_quiet": quiet, "_first": first, "_step": step}).withColumn(
        "alert", F.col("firing") & (since >= hold)).drop("_quiet", "_first", "_step")


def rolling_baseline(counts: DataFrame, span: int, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Mean count of the buckets in the trailing `span` seconds, the current one included."""
    trailing = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-span, 0)
    return counts.withColumn("baseline", F.avg("n").over(trailing))


def surge(counts: DataFrame, span: int, factor: float, keys: Sequence[str] = ("domain",)) -> DataFrame:
    based = rolling_baseline(counts, span, keys)
    return based.withColumn("firing", F.col("n") > F.lit(factor).cast("double") * F.col("baseline"))


def volume_drop_alert(df: DataFrame, keys: Sequence[str] = ("domain",), hold: int = 10 * MINUTE) -> DataFrame:
    """5-minute volume below half its 1-hour average, an alert once it has been for `hold`."""
    counts = with_empty_buckets(bucket_counts(df, 5 * MINUTE, keys), 5 * MINUTE, keys)
    based = rolling_baseline(counts, HOUR, keys)
    return with_hold(based.withColumn("firing", F.col("n") < F.lit(0.5).cast("double") * F.col("baseline")), hold, keys)


def high_stress_surge(df: DataFrame, keys: Sequence[str] = ("domain",), factor: float = 1.2,
                      threshold: float = 0.5, hold: int = 30 * MINUTE) -> DataFrame:
    """Hourly high-stress count above `factor` times its 7-day average, quiet hours included."""
    high = df.filter(F.col("probability") >= threshold)
    return with_hold(surge(with_empty_buckets(bucket_counts(high, HOUR, keys), HOUR, keys), WEEK, factor, keys), hold, keys)


def domain_surge(df: DataFrame, domain: str = "financial_stress", factor: float = 1.3, hold: int = HOUR) -> DataFrame:
    return high_stress_surge(df.filter(F.col("domain") == domain), ("domain",), factor, hold=hold)


def latency_p99_alert(df: DataFrame, seconds: int = 5 * MINUTE, ts: str = "assessed_at",
                      latency: str = "latency") -> DataFrame:
    """Exact p99 per time bucket with its severity."""
    bucketed = df.select(bucket_start(ts, seconds).alias("bucket"), latency)
    p99 = quantiles(bucketed, ["bucket"], latency, {"p99": 0.99}, buckets=16)
    return p99.withColumn("severity", F.when(F.col("p99") > 2.0, "critical")
                          .when(F.col("p99") > 0.5, "warning").otherwise("ok"))


def sustained_condition(series: DataFrame, step: int, hold: int, keys: Sequence[str] = ("domain",),
                        condition: str = "firing") -> DataFrame:
    """Runs of consecutive buckets in which the condition held for at least `hold` seconds.

    A missing bucket ends a run: consecutive buckets differ by `step`, so bucket minus its
    running position is constant within a run.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    held = series.filter(F.col(condition)).withColumn(
        "_island", F.col("bucket") - F.row_number().over(order) * step)
    runs = held.groupBy(*keys, "_island").agg(
        F.min("bucket").alias("run_start"), (F.max("bucket") + step).alias("run_end"),
        F.count(F.lit(1)).alias("buckets"))
    return runs.filter(F.col("run_end") - F.col("run_start") >= hold).drop("_island")


def silence_detector(df: DataFrame, keys: Sequence[str], limit: int, ts: str = "assessed_at") -> DataFrame:
    """Gaps longer than `limit` seconds between consecutive events of a key.

    Two events of one bucket of `limit` seconds are never further apart than the limit, so
    only the first and last event of every bucket matter: an aggregate with map-side
    combine, after which a key has at most (time covered / limit) rows to order.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = df.groupBy(*keys, bucket_start(ts, limit).alias("bucket")).agg(
        F.min(micros).alias("first_us"), F.max(micros).alias("last_us"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    gaps = ends.withColumn("gap_start_us", F.lag("last_us").over(order))
    return (gaps.withColumn("gap_seconds", (F.col("first_us") - F.col("gap_start_us")) / 1000000)
            .filter(F.col("gap_seconds") > limit)
            .select(*keys, "gap_start_us", F.col("first_us").alias("gap_end_us"), "gap_seconds"))
