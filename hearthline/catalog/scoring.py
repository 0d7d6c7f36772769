"""Queries for score post-processing over household profiles."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import flag_of, over
from hearthline.catalog.registry import query, text
from hearthline.functions import scoring as sc
from hearthline.plans.scoring import postprocess

KEYS = "household_id, cast(month_slot AS VARCHAR) AS month_slot"
INC, EXP = "coalesce(monthly_income, 0)", "coalesce(monthly_total_expense, 0)"

# Continuous scores from spending shares stand in for model probabilities.
RAW = {
    "financial_stress": f"least({EXP} / ({INC} + 1e-9) / 2, 1.0)",
    "food_stress": f"least(coalesce(monthly_food_expense, 0) / ({EXP} + 1e-9), 1.0)",
    "debt_stress": f"least(coalesce(monthly_emi, 0) / ({INC} + 1e-9), 1.0)",
    "health_stress": f"least(coalesce(monthly_health_expense, 0) / ({EXP} + 1e-9) * 5, 1.0)",
}
PRIORS = " ".join(f"WHEN '{s}' THEN {p}" for s, p in fv.STATE_PRIORS.items())
ADJUSTED = {label: f"(({raw}) + 0.2::DOUBLE * (CASE state {PRIORS} ELSE 0.42 END)::DOUBLE) / 1.2::DOUBLE"
            for label, raw in RAW.items()}
LIMITS = {
    "financial_stress": "0.35", "food_stress": "0.45", "debt_stress": "0.5",
    "health_stress": f"CASE WHEN {INC} > 150000 THEN 0.65 ELSE 0.5 END",
}
GUARD = "is_hospitalised IS NULL AND is_on_medication IS NULL"
SCORED = f"""(
    SELECT *, {", ".join(f"{ADJUSTED[x]} AS {x}_adj, CASE WHEN {ADJUSTED[x]} >= {LIMITS[x]} THEN 1 ELSE 0 END AS {x}_flag"
                         for x in fv.STRESS_LABELS)},
           {INC} > 0 AND ({INC} - {EXP}) / {INC} < 0.10 AS low_savings FROM profiles)"""


def with_raw(t):
    income, expense = sc._zero("monthly_income"), sc._zero("monthly_total_expense")
    one = F.lit(1.0)
    return t.profiles.withColumns({
        "financial_stress_raw": F.least(sc.share(expense, income) / 2, one),
        "food_stress_raw": F.least(sc.share(sc._zero("monthly_food_expense"), expense), one),
        "debt_stress_raw": F.least(sc.share(sc._zero("monthly_emi"), income), one),
        "health_stress_raw": F.least(sc.share(sc._zero("monthly_health_expense"), expense) * 5, one),
    })


@query("geo_adjust", over(f"""
    SELECT {KEYS}, state, {ADJUSTED['financial_stress']} AS adjusted FROM profiles""", "profiles"))
def geo_adjust(t):
    return with_raw(t).select("household_id", text("month_slot"), "state", sc.geo_adjust(
        F.col("financial_stress_raw"), F.col("state")).alias("adjusted"))


@query("apply_thresholds", over(f"""
    SELECT {KEYS}, {", ".join(f"{x}_flag" for x in fv.STRESS_LABELS)} FROM {SCORED}""", "profiles"))
def apply_thresholds(t):
    income = sc._zero("monthly_income")
    return with_raw(t).select("household_id", text("month_slot"), *[
        sc.apply_thresholds(x, sc.geo_adjust(F.col(f"{x}_raw"), F.col("state")), income).alias(f"{x}_flag")
        for x in fv.STRESS_LABELS])


@query("health_guard", over(f"""
    SELECT {KEYS}, CASE WHEN NOT ({GUARD}) THEN {RAW['health_stress']} END AS health_stress,
           CASE WHEN {GUARD} THEN '{fv.HEALTH_GUARD_MESSAGE}' END AS message FROM profiles""", "profiles"))
def health_guard(t):
    answers = F.col("is_hospitalised"), F.col("is_on_medication")
    return with_raw(t).select("household_id", text("month_slot"), sc.health_guard(
        F.col("health_stress_raw"), *answers).alias("health_stress"), sc.health_message(*answers).alias("message"))


@query("financial_override", over(f"""
    SELECT {KEYS}, low_savings AND financial_stress_flag = 0 AS overridden,
           CASE WHEN low_savings THEN 1 ELSE financial_stress_flag END AS flag,
           CASE WHEN low_savings AND financial_stress_flag = 0 THEN greatest(round_even(financial_stress_adj, 4), 0.4::DOUBLE)
                ELSE round_even(financial_stress_adj, 4) END AS probability FROM {SCORED}""", "profiles"))
def financial_override(t):
    return postprocess(with_raw(t)).select(
        "household_id", text("month_slot"), F.col("financial_stress_override").alias("overridden"),
        F.col("financial_stress_binary").alias("flag"), F.col("financial_stress").alias("probability"))


@query("stress_summary", over(f"""
    SELECT {KEYS}, array_to_string(domains, ',') AS stressed_domains, len(domains) >= 1 AS is_stressed,
           least(len(domains), 3) AS stress_level FROM (
    SELECT *, list_filter([
        CASE WHEN low_savings OR financial_stress_flag = 1 THEN 'financial_stress' END,
        CASE WHEN food_stress_flag = 1 THEN 'food_stress' END, CASE WHEN debt_stress_flag = 1 THEN 'debt_stress' END,
        CASE WHEN health_stress_flag = 1 AND NOT ({GUARD}) THEN 'health_stress' END], lambda x: x IS NOT NULL) AS domains
    FROM {SCORED})""", "profiles"))
def stress_summary(t):
    return postprocess(with_raw(t)).select(
        "household_id", text("month_slot"), F.array_join("stressed_domains", ",").alias("stressed_domains"),
        "is_stressed", "stress_level")


ILL = "coalesce(is_hospitalised, false) OR coalesce(is_on_medication, false)"
RULES = {
    "financial_stress": f"({EXP} - {INC}) / ({INC} + 1e-9) > 0.1 OR ({INC} > 0 AND ({INC} - {EXP}) / nullif({INC}, 0) < 0.10)",
    "food_stress": f"coalesce(monthly_food_expense, 0) / ({EXP} + 1e-9) > 0.5",
    "debt_stress": f"coalesce(monthly_emi, 0) / ({INC} + 1e-9) > 0.3",
    "health_stress": f"coalesce(monthly_health_expense, 0) / ({EXP} + 1e-9) > 0.10 OR {ILL}",
}


@query("rule_based_scores", over(f"""
    SELECT {KEYS}, {", ".join(f"{x}_binary" for x in RULES)},
           {", ".join(f"cast(CASE WHEN {x}_binary = 1 THEN 0.95 ELSE 0.05 END AS DOUBLE) AS {x}"
                      for x in RULES if x != "health_stress")},
           cast(health_stress_binary AS DOUBLE) AS health_stress,
           cast({" + ".join(f"{x}_binary" for x in RULES)} AS DOUBLE) AS composite_stress_score
    FROM (SELECT *, {", ".join(f"{flag_of(r)} AS {x}_binary" for x, r in RULES.items())} FROM profiles)""", "profiles"))
def rule_based_scores(t):
    return sc.rule_based_scores(t.profiles).select(
        "household_id", text("month_slot"), *[f"{x}_binary" for x in RULES], *RULES, fv.COMPOSITE_LABEL)


def percent(expr: str) -> str:
    return f"cast(cast(round_even({expr} * 100, 0) AS BIGINT) AS VARCHAR)"


@query("rule_reasons", over(f"""
    SELECT {KEYS},
           coalesce(nullif(concat_ws('|', CASE WHEN {INC} > 0 THEN 'Spending ' || {percent(f'{EXP} / ({INC} + 1e-9)')} || '% of monthly income' END,
               CASE WHEN {INC} - {EXP} < 2000 THEN 'Near-zero monthly savings' END), ''), '{fv.DEFAULT_REASON}') AS financial,
           CASE WHEN {EXP} > 0 THEN 'Food is ' || {percent(f'coalesce(monthly_food_expense, 0) / ({EXP} + 1e-9)')} || '% of expenses'
                ELSE '{fv.DEFAULT_REASON}' END AS food,
           CASE WHEN {INC} > 0 THEN 'EMI is ' || {percent(f'coalesce(monthly_emi, 0) / ({INC} + 1e-9)')} || '% of income'
                ELSE '{fv.DEFAULT_REASON}' END AS debt,
           '{fv.DEFAULT_REASON}' AS health FROM profiles""", "profiles"))
def rule_reasons(t):
    return t.profiles.select("household_id", text("month_slot"), *[
        F.array_join(sc.rule_reasons(label), "|").alias(label.removesuffix("_stress")) for label in fv.STRESS_LABELS])


@query("profile_defaults", over(f"""
    SELECT {KEYS}, coalesce(monthly_emi, 0) / ({INC} + 1e-9) AS emi_to_income_ratio,
           {INC} - {EXP} AS savings_proxy, coalesce(income_wages, {INC}) AS income_all_members_from_wages,
           round(coalesce(age_head, 35), 6) AS age_years_hh_mean,
           1 - greatest(coalesce(cast(is_hospitalised AS INTEGER), 0), coalesce(cast(is_on_medication AS INTEGER), 0)) AS is_healthy_hh_min,
           coalesce(cast(has_bank_account AS INTEGER), 1) AS has_bank_account_hh_any,
           coalesce(cast(has_credit_card AS INTEGER), 0) AS has_credit_card_hh_any,
           coalesce(cast(has_mobile_phone AS INTEGER), 1) AS has_mobile_phone_hh_any,
           CASE WHEN num_members IS NOT NULL AND monthly_income IS NOT NULL
                THEN least(num_members / (monthly_income / 10000 + 1e-9), 200.0) END AS dependents_ratio,
           ({INC} - {EXP}) / ({EXP} + 1e-9) AS savings_buffer_months,
           CASE WHEN upper(region_type) IN ('RURAL', 'VILLAGE') AND {INC} < 25000 THEN 1 ELSE 0 END AS rural_low_income_flag,
           coalesce(nullif(gender, ''), 'M') AS gender_hh_mode,
           coalesce(nullif(occupation, ''), 'Home Maker') AS occupation_type_hh_mode, age_group FROM profiles""", "profiles"))
def profile_defaults(t):
    features = sc.profile_defaults(t.profiles)
    return features.select(
        "household_id", text("month_slot"), "emi_to_income_ratio", "savings_proxy", "income_all_members_from_wages",
        F.round("age_years_hh_mean", 6).alias("age_years_hh_mean"),
        "is_healthy_hh_min", "has_bank_account_hh_any", "has_credit_card_hh_any", "has_mobile_phone_hh_any",
        "dependents_ratio", "savings_buffer_months", "rural_low_income_flag", "gender_hh_mode",
        "occupation_type_hh_mode", "age_group")


REASONS = {
    "financial_stress": f"""CASE WHEN low_savings AND financial_stress_flag = 0 THEN 'Savings are only '
        || printf('%.1f', round_even(({INC} - {EXP}) / {INC} * 100, 1)) || '% of income (< 10%)|' ELSE '' END
        || coalesce(nullif(concat_ws('|', CASE WHEN {INC} > 0 THEN 'Spending ' || {percent(f'{EXP} / ({INC} + 1e-9)')} || '% of monthly income' END,
        CASE WHEN {INC} - {EXP} < 2000 THEN 'Near-zero monthly savings' END), ''), '{fv.DEFAULT_REASON}')""",
    "food_stress": f"""CASE WHEN {EXP} > 0 THEN 'Food is ' || {percent(f'coalesce(monthly_food_expense, 0) / ({EXP} + 1e-9)')}
        || '% of expenses' ELSE '{fv.DEFAULT_REASON}' END""",
    "debt_stress": f"""CASE WHEN {INC} > 0 THEN 'EMI is ' || {percent(f'coalesce(monthly_emi, 0) / ({INC} + 1e-9)')}
        || '% of income' ELSE '{fv.DEFAULT_REASON}' END""",
    "health_stress": f"'{fv.DEFAULT_REASON}'",
}


@query("batch_postprocess", over(f"""
    SELECT {KEYS}, CASE WHEN low_savings AND financial_stress_flag = 0 THEN greatest(round_even(financial_stress_adj, 4), 0.4::DOUBLE)
               ELSE round_even(financial_stress_adj, 4) END AS financial_stress,
           round_even(food_stress_adj, 4) AS food_stress, round_even(debt_stress_adj, 4) AS debt_stress,
           CASE WHEN NOT ({GUARD}) THEN round_even(health_stress_adj, 4) END AS health_stress,
           {", ".join(f"{text} AS {label}_reasons" for label, text in REASONS.items())},
           least(3, cast(low_savings OR financial_stress_flag = 1 AS INTEGER) + food_stress_flag + debt_stress_flag
               + CASE WHEN {GUARD} THEN 0 ELSE health_stress_flag END) AS stress_level,
           '{fv.MODEL_VERSION}' AS model_version FROM {SCORED}""", "profiles"))
def batch_postprocess(t):
    done = postprocess(with_raw(t))
    return done.select("household_id", text("month_slot"), *fv.STRESS_LABELS,
                       *[F.array_join(f"{x}_reasons", "|").alias(f"{x}_reasons") for x in fv.STRESS_LABELS],
                       "stress_level", "model_version")
