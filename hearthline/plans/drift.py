"""Drift between a baseline and current rows, and the retraining decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.operators.order_stats import long_form, quantile_columns, running_totals
from hearthline.operators.profile import null_profile
from hearthline.session import cut_lineage

DISTANCE_LIMIT = 0.1
P_VALUE_LIMIT = 0.05
MIN_STD = 0.001
PSI_FLOOR = 0.0001


def baseline_rows(df: DataFrame, label: str = "financial_stress") -> DataFrame:
    """The labelled rows: drift is measured against all of them, not against a sample."""
    return df.filter(F.col(label).isNotNull())


def align_columns(baseline: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides on their shared columns, in baseline order."""
    shared = [c for c in baseline.columns if c in current.columns]
    return baseline.select(shared), current.select(shared)


def ks_p_value(distance: Column, n: Column, m: Column, terms: int = 30) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    effective = F.sqrt(n * m / (n + m))
    lam = (effective + 0.12 + 0.11 / effective) * distance
    series = F.lit(0.0)
    for k in range(1, terms + 1):
        series = series + (1 if k % 2 else -1) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def numeric_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str],
                  method: str = "wasserstein") -> DataFrame:
    """KS distance, normalised Wasserstein distance and PSI over baseline deciles, per column.

    Both sides collapse to one row per (column, value) before any ordering. Both measures are
    returned; `method` ('wasserstein' or 'ks') says which decides `drifted`, whatever the size.
    """
    if method not in ("wasserstein", "ks"):
        raise ValueError(f"unknown drift method {method}")
    rows = long_form(baseline, columns).withColumn("b", F.lit(1)).unionByName(
        long_form(current, columns).withColumn("b", F.lit(0))).filter(F.col("value").isNotNull())
    counts = cut_lineage(rows.groupBy("feature", "value").agg(
        F.sum("b").alias("base"), F.sum(1 - F.col("b")).alias("cur")))
    placed = running_totals(counts, ["feature"], "value", ["base", "cur"], few_groups=True, written=True)
    gap = F.abs(F.try_divide(F.col("cum_base").cast("double"), F.col("total_base"))
                - F.try_divide(F.col("cum_cur").cast("double"), F.col("total_cur")))
    deciles = {f"d{i}": i / 10 for i in range(1, 10)}
    picks, finals = quantile_columns(deciles, "value", "base")
    summary = placed.groupBy("feature").agg(
        F.max("total_base").alias("n_base"), F.max("total_cur").alias("n_cur"), F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("_area"),
        (F.sum(F.col("base") * F.col("value")) / F.max("total_base")).alias("_mean"), *picks,
    ).select("feature", "n_base", "n_cur", "ks", "_area", "_mean", F.array(*finals).alias("_edges"))
    apart = F.col("value") - F.col("_mean")
    bins = counts.join(F.broadcast(summary), "feature").groupBy(
        "feature", F.size(F.filter("_edges", lambda e: e < F.col("value"))).alias("bin")).agg(
        F.max(F.struct("n_base", "n_cur", "ks", "_area")).alias("s"),
        F.sum("base").alias("base"), F.sum("cur").alias("cur"),
        F.sum(F.col("base") * apart * apart).alias("squares"))

    def part(count: str, total: str) -> Column:
        return F.greatest(F.try_divide(F.col(count).cast("double"), F.col(f"s.{total}")), F.lit(PSI_FLOOR))

    p, q = part("base", "n_base"), part("cur", "n_cur")
    spread = F.greatest(F.sqrt(F.sum("squares") / F.max("s.n_base")), F.lit(MIN_STD))
    scored = bins.groupBy("feature").agg(
        F.max("s").alias("s"), F.sum((q - p) * F.ln(q / p)).alias("psi"), spread.alias("_std"),
    ).select("feature", "s.n_base", "s.n_cur", "s.ks", "psi", (F.col("s._area") / F.col("_std")).alias("wasserstein")
             ).withColumn("ks_p_value", ks_p_value(
                 F.col("ks"), F.col("n_base").cast("double"), F.col("n_cur").cast("double")))
    drifted = F.col("wasserstein") >= DISTANCE_LIMIT if method == "wasserstein" else F.col("ks_p_value") < P_VALUE_LIMIT
    return scored.withColumn("drifted", F.coalesce(drifted, F.lit(False))).withColumn("method", F.lit(method))


def categorical_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance and chi-square statistic over level shares, per column."""
    def long(df: DataFrame, b: int) -> DataFrame:
        return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
            [], list(columns), "feature", "level").filter(F.col("level").isNotNull()).withColumn("b", F.lit(b))

    counts = long(baseline, 1).unionByName(long(current, 0)).groupBy("feature", "level").agg(
        F.sum("b").alias("base"), F.sum(1 - F.col("b")).alias("cur"))
    totals = counts.groupBy("feature").agg(F.sum("base").alias("n_base"), F.sum("cur").alias("n_cur"))
    p = F.try_divide(F.col("base").cast("double"), F.col("n_base"))
    q = F.try_divide(F.col("cur").cast("double"), F.col("n_cur"))

    def entropy_part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("m"))).otherwise(F.lit(0.0))

    shares = counts.join(F.broadcast(totals), "feature").withColumns({"p": p, "q": q}).withColumn(
        "m", (F.col("p") + F.col("q")) / 2)
    expected = F.col("n_cur") * F.col("p")
    return shares.groupBy("feature").agg(
        F.max("n_base").alias("n_base"), F.max("n_cur").alias("n_cur"), F.count(F.lit(1)).alias("levels"),
        F.sqrt(F.greatest(F.sum((entropy_part("p") + entropy_part("q")) / 2), F.lit(0.0))).alias("js_distance"),
        F.sum(F.when(expected > 0, (F.col("cur") - expected) * (F.col("cur") - expected) / expected)
              ).alias("chi_square"),
    ).withColumn("drifted", F.coalesce(F.col("js_distance") >= DISTANCE_LIMIT, F.lit(False)))


def missing_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing percent per column on both sides."""
    b = null_profile(baseline, columns).select("column_name", F.col("missing_pct").alias("baseline_pct"))
    c = null_profile(current, columns).select("column_name", F.col("missing_pct").alias("current_pct"))
    return b.join(F.broadcast(c), "column_name").withColumn(
        "change_pct", F.col("current_pct") - F.col("baseline_pct"))


def drift_share(*drifts: DataFrame) -> DataFrame:
    """Share of drifted columns over any number of drift tables, and the alert."""
    both = drifts[0].select("feature", "drifted")
    for other in drifts[1:]:
        both = both.unionByName(other.select("feature", "drifted"))
    return both.agg(F.count(F.lit(1)).alias("columns"), F.count_if("drifted").alias("drifted_columns"),
                    F.avg(F.col("drifted").cast("double")).alias("drift_share")).withColumn(
        "alert", F.col("drift_share") > fv.DRIFT_SHARE_LIMIT)


def retrain_decision(share: DataFrame, rate: DataFrame) -> DataFrame:
    """One row: both measures, the reasons that call for retraining and the decision."""
    decided = share.select(F.coalesce("drift_share", F.lit(0.0)).alias("drift_share")).withColumn(
        "stress_rate", rate.select("stress_rate").scalar()).withColumn(
        "rate_shift", F.abs(F.col("stress_rate") - fv.BASELINE_STRESS_RATE))
    reasons = F.array_compact(F.array(
        F.when(F.col("drift_share") > fv.DRIFT_SHARE_LIMIT,
               F.format_string(f"dataset drift %.2f%% > {fv.DRIFT_SHARE_LIMIT:.0%}%", F.bround(F.col("drift_share") * 100, 2))),
        F.when(F.col("rate_shift") > fv.RATE_SHIFT_LIMIT,
               F.format_string(f"stress rate shift %.2f%% > {fv.RATE_SHIFT_LIMIT:.0%}%", F.bround(F.col("rate_shift") * 100, 2))),
    ))
    return decided.withColumn("reasons", F.array_join(reasons, "; ")).withColumn(
        "retrain", F.col("reasons") != "")


def prediction_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shift of the mean prediction per column, with the alert."""
    b = long_form(baseline, columns).groupBy("feature").agg(F.avg("value").alias("baseline_mean"))
    c = long_form(current, columns).groupBy("feature").agg(F.avg("value").alias("current_mean"))
    return b.join(c, "feature").withColumn(
        "shift", F.abs(F.col("current_mean") - F.col("baseline_mean"))).withColumn(
        "alert", F.col("shift") > fv.RATE_SHIFT_LIMIT)
