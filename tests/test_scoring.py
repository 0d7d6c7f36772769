"""The four questionnaire inputs: full, partial, without health answers, empty."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import fixed_values as fv
from hearthline.functions import features as ft
from hearthline.functions import scoring as sc
from hearthline.plans.scoring import postprocess

NUMBERS = ["monthly_income", "monthly_total_expense", "monthly_food_expense", "monthly_emi", "monthly_health_expense",
           "monthly_education_expense", "monthly_recreation_expense", "monthly_vacation_expense",
           "monthly_restaurant_expense", "income_wages", "income_rent", "income_self_production",
           "income_private_transfers", "income_business", "num_members", "age_head", "education_rank"]
FLAGS = ["is_hospitalised", "is_on_medication", "has_bank_account", "has_health_insurance", "has_life_insurance",
         "has_provident_fund", "has_credit_card", "has_demat_account", "has_mobile_phone"]
TEXTS = ["name", "state", "region_type", "age_group", "occupation_group", "education_group", "gender_group",
         "household_size_group", "gender", "occupation", "education"]
SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in NUMBERS]
                      + [T.StructField(c, T.BooleanType()) for c in FLAGS]
                      + [T.StructField(c, T.StringType()) for c in TEXTS])
FULL = dict(name="full", monthly_income=45000.0, monthly_total_expense=38000.0, monthly_food_expense=12000.0,
            monthly_emi=8000.0, monthly_health_expense=2000.0, monthly_education_expense=3000.0,
            monthly_recreation_expense=1500.0, monthly_vacation_expense=500.0, monthly_restaurant_expense=1000.0,
            income_wages=45000.0, income_rent=0.0, income_business=0.0, is_hospitalised=False, is_on_medication=False,
            has_bank_account=True, has_health_insurance=True, has_life_insurance=False, has_provident_fund=True,
            has_credit_card=False, has_demat_account=False, state="Maharashtra", region_type="Urban", age_head=38.0,
            occupation="Salaried", education="Graduate", gender="M")
PARTIAL = dict(name="partial", monthly_income=30000.0, monthly_total_expense=27000.0, monthly_food_expense=9000.0,
               monthly_emi=5000.0, is_hospitalised=False, is_on_medication=False, state="Uttar Pradesh", region_type="Rural")
NO_HEALTH = dict(name="no_health", monthly_income=25000.0, monthly_total_expense=22000.0, monthly_food_expense=7000.0,
                 state="Tamil Nadu")


def profiles(spark, *rows):
    return spark.createDataFrame([tuple({**dict.fromkeys(SCHEMA.names), **r}[c] for c in SCHEMA.names) for r in rows], SCHEMA)


def scored(spark, raw, *rows):
    df = profiles(spark, *rows).withColumns({f"{label}_raw": F.lit(raw) for label in fv.STRESS_LABELS})
    return {r["name"]: r for r in postprocess(df).collect()}


def test_all_four_inputs_score(spark):
    out = scored(spark, 0.3, FULL, PARTIAL, NO_HEALTH, dict(name="empty"))
    assert len(out) == 4
    for row in out.values():
        assert all(0 <= row[x] <= 1 for x in fv.STRESS_LABELS[:3])
    assert out["no_health"].health_stress is None and "hospitalised" in out["no_health"].health_stress_message
    assert out["full"].health_stress is not None and out["full"].health_stress_message is None


def test_guard_needs_only_one_answer(spark):
    out = scored(spark, 0.3, {**NO_HEALTH, "is_hospitalised": False})
    assert out["no_health"].health_stress is not None


@pytest.mark.parametrize("expense, overridden", [(27001.0, True), (26999.0, False)])
def test_override_on_both_sides_of_the_savings_limit(spark, expense, overridden):
    row = scored(spark, 0.1, {**PARTIAL, "monthly_total_expense": expense})["partial"]
    assert row.financial_stress_override is overridden
    assert row.financial_stress_binary == int(overridden)
    if overridden:
        assert row.financial_stress == 0.40 and row.financial_stress_reasons[0].startswith("Savings are only 10.0%")


def test_unknown_flag_is_not_overridden(spark):
    df = profiles(spark, {**PARTIAL, "monthly_total_expense": 29000.0}).select(
        "*", F.lit(None).cast("double").alias("financial_stress"), F.lit(None).cast("int").alias("financial_stress_binary"),
        F.array(F.lit("x")).alias("financial_stress_reasons"))
    row = sc.financial_override(df).first()
    assert row.financial_stress_override is False and row.financial_stress_binary is None


def test_health_threshold_rises_with_income(spark):
    df = spark.createDataFrame([(0.6, 150000.0), (0.6, 150001.0)], "p double, income double")
    flags = df.select(sc.apply_thresholds("health_stress", F.col("p"), F.col("income")).alias("f")).collect()
    assert [r.f for r in flags] == [1, 0]


def test_state_prior(spark):
    df = spark.createDataFrame([("Bihar",), ("Nowhere",), (None,)], "state string")
    got = [r[0] for r in df.select(sc.geo_adjust(F.lit(0.5), F.col("state"))).collect()]
    assert got == pytest.approx([(0.5 + 0.2 * p) / 1.2 for p in (0.70, 0.42, 0.42)])


def test_rules(spark):
    rows = {r["name"]: r for r in sc.rule_based_scores(profiles(spark, FULL, {**FULL, "name": "ill", "is_hospitalised": True})).collect()}
    assert [rows["full"][x] for x in fv.STRESS_LABELS] == [0.05, 0.05, 0.05, 0.0]
    assert rows["ill"].health_stress == 1.0 and rows["ill"].composite_stress_score == 1.0


def test_defaults_fill_every_feature(spark):
    row = sc.profile_defaults(profiles(spark, dict(name="empty"))).first()
    assert set(fv.NUMERIC_FEATURES + fv.CATEGORICAL_FEATURES) <= set(row.asDict())
    assert (row.state, row.region_type, row.age_years_hh_mean, row.has_bank_account_hh_any) == ("Maharashtra", "URBAN", 35.0, 1)
    assert row.dependents_ratio is None


@pytest.mark.parametrize("members, income, expected", [(4.0, 0.0, 200.0), (4.0, 20000.0, 2.0), (None, 20000.0, None), (4.0, None, None), (0.0, 0.0, 0.0)])
def test_dependants_agree_in_training_and_scoring(spark, members, income, expected):
    served = sc.profile_defaults(profiles(spark, dict(name="x", num_members=members, monthly_income=income))).first().dependents_ratio
    df = spark.createDataFrame([(members, income)], "size double, income double")
    trained = df.select(ft.dependents_ratio(F.col("size"), F.col("income"))).first()[0]
    assert served == trained == (None if expected is None else pytest.approx(expected))
