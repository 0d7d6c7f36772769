"""Score post-processing as row expressions: calibration, thresholds, guards, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.functions import features as ft
from hearthline.functions.labels import flag, share
from hearthline.operators.joins import prior_of_state


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def geo_adjust(probability: Column, state: Column) -> Column:
    """Shrink a probability towards the prior of its state."""
    weight = F.lit(fv.STATE_PRIOR_WEIGHT)
    return (probability + weight * prior_of_state(state)) / (1.0 + weight)


def threshold_of(label: str, income: Column) -> Column:
    base = F.lit(fv.SERVING_THRESHOLDS[label])
    if label == "health_stress":
        return F.when(income > fv.HIGH_INCOME, F.lit(fv.HIGH_INCOME_HEALTH_THRESHOLD)).otherwise(base)
    return base


def apply_thresholds(label: str, probability: Column, income: Column) -> Column:
    """0/1 by the serving threshold, on the unrounded probability; null stays null."""
    return (probability >= threshold_of(label, income)).cast("int")


def health_missing(hospitalised: Column, medication: Column) -> Column:
    return hospitalised.isNull() & medication.isNull()


def health_guard(value: Column, hospitalised: Column, medication: Column) -> Column:
    """No health score without at least one of the two health answers."""
    return F.when(~health_missing(hospitalised, medication), value)


def health_message(hospitalised: Column, medication: Column) -> Column:
    return F.when(health_missing(hospitalised, medication), F.lit(fv.HEALTH_GUARD_MESSAGE))


def savings_share(income: Column, expense: Column) -> Column:
    return F.when(income > 0, F.try_divide(income - expense, income))


def low_savings(income: Column, expense: Column) -> Column:
    return F.coalesce(savings_share(income, expense) < fv.LOW_SAVINGS_SHARE, F.lit(False))


def financial_override(df: DataFrame, income: str = "monthly_income",
                       expense: str = "monthly_total_expense") -> DataFrame:
    """Low savings raise an unset financial flag, its probability and its first reason.

    Needs financial_stress, financial_stress_binary and the reasons array
    financial_stress_reasons; an unknown flag is left alone.
    """
    low = low_savings(_zero(income), _zero(expense))
    fires = F.coalesce(low & (F.col("financial_stress_binary") == 0), F.lit(False))
    reason = F.format_string("Savings are only %.1f%% of income (< 10%%)",
                             F.bround(savings_share(_zero(income), _zero(expense)) * 100, 1))
    return df.withColumn("financial_stress_override", fires).withColumns({
        "financial_stress": F.when(fires, F.greatest("financial_stress", F.lit(fv.OVERRIDE_PROBABILITY)))
        .otherwise(F.col("financial_stress")),
        "financial_stress_binary": F.when(fires, F.lit(1)).otherwise(F.col("financial_stress_binary")),
        "financial_stress_reasons": F.when(
            fires, F.array_prepend("financial_stress_reasons", reason)).otherwise(
            F.col("financial_stress_reasons")),
    })


def stress_summary(df: DataFrame) -> DataFrame:
    """Stressed domains, whether any, and the level (at most 3)."""
    domains = F.array_compact(F.array(*[
        F.when(F.col(f"{label}_binary") == 1, F.lit(label)) for label in fv.STRESS_LABELS]))
    return df.withColumn("stressed_domains", domains).withColumns({
        "is_stressed": F.size("stressed_domains") >= 1,
        "stress_level": F.least(F.size("stressed_domains"), F.lit(3)),
    })


def rule_based_scores(df: DataFrame) -> DataFrame:
    """The four rules as scores and flags; needs no model."""
    income, expense = _zero("monthly_income"), _zero("monthly_total_expense")
    ill = F.coalesce(F.col("is_hospitalised"), F.lit(False)) | F.coalesce(F.col("is_on_medication"), F.lit(False))
    rules = {
        "financial_stress": (share(expense - income, income) > fv.FINANCIAL_GAP_LIMIT)
        | low_savings(income, expense),
        "food_stress": share(_zero("monthly_food_expense"), expense) > fv.FOOD_SHARE_LIMIT,
        "debt_stress": share(_zero("monthly_emi"), income) > fv.EMI_SHARE_LIMIT,
        "health_stress": (share(_zero("monthly_health_expense"), expense) > fv.HEALTH_SHARE_LIMIT) | ill,
    }
    flagged = df.withColumns({f"{label}_binary": flag(rule) for label, rule in rules.items()})

    def score(label: str) -> Column:
        raw = F.col(f"{label}_binary").cast("double")
        return raw if label == "health_stress" else F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.95))

    total = sum((F.col(f"{label}_binary") for label in rules), F.lit(0)).cast("double")
    return flagged.withColumns({**{label: score(label) for label in rules}, fv.COMPOSITE_LABEL: total})


def rule_reasons(label: str) -> Column:
    """Up to three sentences for one domain, with a default when no rule speaks."""
    income, expense = _zero("monthly_income"), _zero("monthly_total_expense")
    emi, food = _zero("monthly_emi"), _zero("monthly_food_expense")
    sentences = {
        "financial_stress": [
            F.when(income > 0, F.format_string("Spending %.0f%% of monthly income",
                                               F.bround(share(expense, income) * 100, 0))),
            F.when(income - expense < 2000, F.lit("Near-zero monthly savings")),
        ],
        "food_stress": [
            F.when(expense > 0, F.format_string("Food is %.0f%% of expenses", F.bround(share(food, expense) * 100, 0))),
        ],
        "debt_stress": [
            F.when(income > 0, F.format_string("EMI is %.0f%% of income", F.bround(share(emi, income) * 100, 0))),
        ],
        "health_stress": [],
    }[label]
    found = F.array_compact(F.array(*sentences)) if sentences else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit(fv.DEFAULT_REASON)))


def confidence_of(std: Column) -> Column:
    return F.when(std > fv.UNCERTAIN_STD, "uncertain").otherwise("high")


def profile_defaults(df: DataFrame) -> DataFrame:
    """Questionnaire profiles to model features, missing answers replaced by defaults.

    The engineered features use the definitions training uses; members or income that are not
    known leave the ratio of dependants unknown on both paths, and an income of 0 caps it.
    """
    def yes(name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).cast("int")

    def text(name: str, default: str | None = None) -> Column:
        value = F.nullif(F.col(name), F.lit(""))
        return F.coalesce(value, F.lit(default)) if default is not None else value

    income, expense = _zero("monthly_income"), _zero("monthly_total_expense")
    sources = {
        "income_all_members_from_wages": F.coalesce(F.col("income_wages"), income),
        "income_household_from_rent": _zero("income_rent"),
        "income_household_from_self_production": _zero("income_self_production"),
        "income_household_from_private_transfers": _zero("income_private_transfers"),
        "income_household_from_business_profit": _zero("income_business"),
    }
    hospitalised, medication = yes("is_hospitalised", False), yes("is_on_medication", False)
    insured = yes("has_health_insurance", False)
    health_ratio = share(_zero("monthly_health_expense"), expense)
    emi_ratio = share(_zero("monthly_emi"), income)
    region = F.upper(text("region_type", "URBAN"))
    leisure = (_zero("monthly_recreation_expense") + _zero("monthly_vacation_expense")
               + _zero("monthly_restaurant_expense"))
    features = {
        "emi_to_income_ratio": emi_ratio,
        "food_to_expense_ratio": share(_zero("monthly_food_expense"), expense),
        "health_to_expense_ratio": health_ratio,
        "education_to_expense_ratio": share(_zero("monthly_education_expense"), expense),
        "discretionary_to_expense_ratio": share(leisure, expense),
        "savings_proxy": income - expense,
        "income_diversity_score": sum((flag(c > 0) for c in sources.values()), F.lit(0)),
        "age_years_hh_mean": F.coalesce(F.col("age_head"), F.lit(35.0)),
        "education_rank_hh_max": F.col("education_rank"),
        "exp_all_emis": _zero("monthly_emi"),
        "exp_food_adjusted": _zero("monthly_food_expense"),
        "exp_health": _zero("monthly_health_expense"),
        "exp_education": _zero("monthly_education_expense"),
        "exp_recreation": _zero("monthly_recreation_expense"),
        "exp_vacation": _zero("monthly_vacation_expense"),
        "exp_restaurants_adjusted": _zero("monthly_restaurant_expense"),
        **sources,
        "is_healthy_hh_min": 1 - F.greatest(hospitalised, medication),
        "is_hospitalised_hh_any": hospitalised,
        "is_on_regular_medication_hh_any": medication,
        "has_bank_account_hh_any": yes("has_bank_account", True),
        "has_health_insurance_hh_any": insured,
        "has_life_insurance_hh_any": yes("has_life_insurance", False),
        "has_provident_fund_account_hh_any": yes("has_provident_fund", False),
        "has_credit_card_hh_any": yes("has_credit_card", False),
        "has_demat_account_hh_any": yes("has_demat_account", False),
        "has_mobile_phone_hh_any": yes("has_mobile_phone", True),
        "dependents_ratio": ft.dependents_ratio(F.col("num_members"), F.col("monthly_income")),
        "savings_buffer_months": ft.savings_buffer_months(income - expense, expense=expense),
        "no_insurance_vulnerability": ft.no_insurance_vulnerability(insured, health_ratio),
        "rural_low_income_flag": ft.rural_low_income_flag(region, income),
        "emi_health_interaction": ft.emi_health_interaction(emi_ratio, hospitalised, medication),
        "state": text("state", "Maharashtra"),
        "region_type": region,
        "age_group": text("age_group"),
        "occupation_group": text("occupation_group"),
        "education_group": text("education_group"),
        "gender_group": text("gender_group"),
        "household_size_group": text("household_size_group"),
        "gender_hh_mode": text("gender", "M"),
        "occupation_type_hh_mode": text("occupation", "Home Maker"),
        "education_level_hh_mode": text("education", "Graduate"),
    }
    return df.withColumns(features)
