"""Reads over the assessment and conversation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv


def since(as_of: str | Column, days: int) -> Column:
    moment = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return moment - F.make_interval(days=F.lit(days))


def read_recent_assessments(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Assessments of the last `days` before `as_of`, newest first; the filter reaches the scan."""
    return (df.filter(F.col("assessed_at") >= since(as_of, days))
            .orderBy(F.desc("assessed_at"), F.desc("conversation_id")))


def latest_per_conversation(df: DataFrame, key: str = "conversation_id",
                            order: Sequence[str] = ("assessed_at",)) -> DataFrame:
    """Newest row per key by `max_by`, which combines map-side where row_number would not."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def recent_history(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest assessments with a confidence: a top-k, never a full sort."""
    return (df.filter(F.col("prediction_confidence").isNotNull())
            .orderBy(F.desc("assessed_at"), F.desc("conversation_id")).limit(limit))


def stress_rate(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Share of stressed assessments in the window; the baseline rate when it is empty."""
    recent = df.filter(F.col("assessed_at") >= since(as_of, days))
    stressed = F.when(F.col("is_stressed"), F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")
    return recent.agg(F.coalesce(F.avg(stressed), F.lit(fv.BASELINE_STRESS_RATE)).alias("stress_rate"))


def mean_confidence(stds: Column) -> Column:
    """Mean of the non-null deviations in an array, null when there is none."""
    present = F.filter(stds, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def transcript(messages: DataFrame, limit: int = 200) -> DataFrame:
    """Messages in conversation order with a preview cut at `limit` characters."""
    text = F.col("text")
    preview = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)
    return messages.withColumn("preview", preview).orderBy("conv_id", "turn")


def ab_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model_version", "ab_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_stressed").alias("stressed"),
        F.avg("financial_stress_prob").alias("mean_financial"))


def conversation_durations(messages: DataFrame, key: str, ts: str) -> DataFrame:
    """Start, end, messages and seconds per conversation."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return messages.groupBy(key).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("messages"),
        (seconds / 1000000).alias("seconds"))


def completed_share_per_day(conversations: DataFrame) -> DataFrame:
    done = F.when(F.col("completed"), F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")
    return conversations.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("conversations"), F.avg(done).alias("completed_share"))
