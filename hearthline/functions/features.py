"""Engineered features. One definition serves training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.functions.labels import flag, share


def dependents_ratio(size: Column, income: Column, variant: str = "train") -> Column:
    """Members per 10,000 of income, at most 200; `serve` is null without income."""
    ratio = size / (income / 10000 + fv.EPS)
    if variant == "serve":
        return F.when(income > 0, F.least(ratio, F.lit(fv.DEPENDENTS_RATIO_CAP)))
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(fv.DEPENDENTS_RATIO_CAP)))


def savings_buffer_months(proxy: Column, expense: Column | None = None,
                          wages: Column | None = None) -> Column:
    """Savings per unit of spending, or per unit of turnover where spending is gone."""
    if expense is not None:
        return share(proxy, expense)
    return share(proxy, F.abs(proxy) + wages)


def no_insurance_vulnerability(insured: Column, health_ratio: Column) -> Column:
    return (1 - F.coalesce(insured, F.lit(0))) * F.coalesce(health_ratio, F.lit(0.0))


def rural_low_income_flag(region: Column, income: Column) -> Column:
    rural = F.upper(region).isin("RURAL", "VILLAGE")
    return flag(rural & (F.coalesce(income, F.lit(0.0)) < fv.LOW_INCOME_LIMIT))


def emi_health_interaction(emi_ratio: Column, hospitalised: Column, medication: Column) -> Column:
    sick = F.least(F.coalesce(hospitalised, F.lit(0)) + F.coalesce(medication, F.lit(0)), F.lit(1))
    return F.coalesce(emi_ratio, F.lit(0.0)) * sick


def recency_weight(month: Column, cutoff: str = fv.RECENCY_CUTOFF,
                   weight: float = fv.RECENCY_WEIGHT) -> Column:
    return F.when(month >= F.lit(cutoff).cast("date"), F.lit(weight)).otherwise(F.lit(1.0))


def engineer_features(df: DataFrame, variant: str = "totals") -> DataFrame:
    """Add the five engineered features and the recency weight.

    `variant='totals'` is computed while the totals are still present and is what training
    and scoring share. `variant='wages'` reproduces training after the totals are dropped.
    """
    wages = F.col("income_all_members_from_wages")
    proxy = F.col("savings_proxy")
    size = F.col("num_members") if "num_members" in df.columns else F.lit(None).cast("double")
    if variant == "totals":
        buffer = savings_buffer_months(proxy, expense=F.col("total_expenditure_adjusted"))
    else:
        buffer = savings_buffer_months(proxy, wages=wages)
    income = F.col("total_income") if variant == "totals" else wages
    engineered = df.withColumns({
        "dependents_ratio": dependents_ratio(size, income),
        "savings_buffer_months": buffer,
        "no_insurance_vulnerability": no_insurance_vulnerability(
            F.col("has_health_insurance_hh_any"), F.col("health_to_expense_ratio")),
        "rural_low_income_flag": rural_low_income_flag(F.col("region_type"), income),
        "emi_health_interaction": emi_health_interaction(
            F.col("emi_to_income_ratio"), F.col("is_hospitalised_hh_any"),
            F.col("is_on_regular_medication_hh_any")),
    })
    if "month_slot" in df.columns:
        return engineered.withColumn("recency_weight", recency_weight(F.col("month_slot")))
    return engineered.withColumn("recency_weight", F.lit(1.0))
