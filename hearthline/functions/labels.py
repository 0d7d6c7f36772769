"""Stress labels and ratio features as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv


def flag(condition: Column) -> Column:
    """A condition as 0/1, with unknown as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def label_financial(expense: Column, income: Column) -> Column:
    return flag((expense - income) / (income + fv.EPS) > fv.FINANCIAL_GAP_LIMIT)


def label_food(food: Column, expense: Column) -> Column:
    return flag(food / (expense + fv.EPS) > fv.FOOD_SHARE_LIMIT)


def label_debt(emi: Column, income: Column) -> Column:
    return flag(emi / (income + fv.EPS) > fv.EMI_SHARE_LIMIT)


def label_health(hospitalised: Column, medication: Column) -> Column:
    return F.greatest(flag(hospitalised > 0), flag(medication > 0))


def label_health_che(health_ratio: Column, limit: float = fv.HEALTH_SHARE_LIMIT) -> Column:
    """Catastrophic health expenditure: health share of spending above the limit."""
    return flag(health_ratio > limit)


def label_composite(*labels: Column) -> Column:
    total = F.coalesce(labels[0], F.lit(0))
    for label in labels[1:]:
        total = total + F.coalesce(label, F.lit(0))
    return total.cast("int")


def _pick(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def compute_labels(df: DataFrame, health_label: str = "members") -> DataFrame:
    """Four labels and their sum. A label whose inputs are absent is null and counts as 0.

    `health_label` is 'members' (hospitalised or medicated) or 'che' (health share of
    spending), the latter needing `health_to_expense_ratio`.
    """
    absent = F.lit(None).cast("int")

    def when_present(columns: list[str], build) -> Column:
        return build(*map(F.col, columns)) if all(c in df.columns for c in columns) else absent

    if health_label == "che":
        health = label_health_che(F.col("health_to_expense_ratio"))
    else:
        zero = F.lit(0)
        health = label_health(_pick(df, "is_hospitalised_hh_any", zero),
                              _pick(df, "is_on_regular_medication_hh_any", zero))
    labelled = df.withColumns({
        "financial_stress": when_present(["total_expenditure_adjusted", "total_income"], label_financial),
        "food_stress": when_present(["exp_food_adjusted", "total_expenditure_adjusted"], label_food),
        "debt_stress": when_present(["exp_all_emis", "total_income"], label_debt),
        "health_stress": health,
    })
    return labelled.withColumn(fv.COMPOSITE_LABEL, label_composite(*map(F.col, fv.STRESS_LABELS)))


def relabel_health_che(df: DataFrame) -> DataFrame:
    """Replace the health label by the spending-share rule and recompute the composite."""
    relabelled = df.withColumn("health_stress", label_health_che(F.col("health_to_expense_ratio")))
    return relabelled.withColumn(fv.COMPOSITE_LABEL, label_composite(*map(F.col, fv.STRESS_LABELS)))


def share(part: Column, whole: Column) -> Column:
    return part / (whole + fv.EPS)


def compute_ratios(df: DataFrame) -> DataFrame:
    """Seven ratio features; missing amounts count as 0."""
    zero = F.lit(0.0)

    def amount(name: str) -> Column:
        return F.coalesce(_pick(df, name, zero), zero)

    expense, income = amount("total_expenditure_adjusted"), amount("total_income")
    sources = [flag(F.col(c) > 0) for c in fv.INCOME_SOURCES if c in df.columns]
    diversity = sources[0] if sources else F.lit(0)
    for source in sources[1:]:
        diversity = diversity + source
    return df.withColumns({
        "emi_to_income_ratio": share(amount("exp_all_emis"), income),
        "food_to_expense_ratio": share(amount("exp_food_adjusted"), expense),
        "health_to_expense_ratio": share(amount("exp_health"), expense),
        "education_to_expense_ratio": share(amount("exp_education"), expense),
        "discretionary_to_expense_ratio": share(
            amount("exp_recreation") + amount("exp_vacation") + amount("exp_restaurants_adjusted"),
            expense),
        "savings_proxy": income - expense,
        "income_diversity_score": diversity.cast("int"),
    })
