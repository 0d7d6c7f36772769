"""Quantiles of many columns from brackets, and fits that run side by side."""

import math
from threading import Barrier
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog import survey_views, training as queries
from hearthline.operators import order_stats as st
from hearthline.operators.profile import feature_bounds
from hearthline.plans import training as tr
from hearthline.session import side_by_side


@pytest.fixture(scope="module")
def wide(spark):
    """20,000 rows: numbers that all differ, few levels, a point mass, few values, extremes, none."""
    return spark.range(20_000, numPartitions=4).select(
        (F.xxhash64("id") / F.lit(1e6).cast("double")).alias("differ"), (F.col("id") % 7).alias("levels"),
        F.when(F.col("id") % 50 == 0, F.col("id").cast("double")).otherwise(F.lit(-0.0)).alias("mass"),
        F.when(F.col("id") % 4000 == 3, F.col("id")).alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 1000 == 1, F.lit(math.inf)).otherwise(-F.col("id")).alias("odd"),
        F.lit(None).cast("double").alias("none"))


def test_bracketed_quantiles_are_those_of_all_values(wide):
    asked = {"p0": 0.0, "p1": 0.01, "median": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r.feature: r for r in st.column_quantiles(wide, wide.columns, asked).collect()}
    whole = {r.feature: r for r in st.quantiles(st.long_form(wide, wide.columns), ["feature"], "value", asked, few_groups=True).collect()}
    assert set(found) == set(whole) == {"differ", "levels", "mass", "few", "odd"}
    for c, r in whole.items():
        assert repr([found[c][n] for n in asked]) == repr([r[n] for n in asked])
    values = np.array([r[0] for r in wide.select("differ").collect()])
    assert found["differ"].p99 == pytest.approx(np.quantile(values, 0.99))


def test_only_values_near_the_ranks_are_grouped(wide, monkeypatch):
    seen, ranked = [], st.running_totals
    monkeypatch.setattr(st, "running_totals", lambda df, *a, **k: seen.append(df.count()) or ranked(df, *a, **k))
    feature_bounds(wide, ["differ", "levels", "mass"]).collect()
    assert 0 < sum(seen) < 0.02 * 20_000


@pytest.mark.parametrize("n", [0, 1, 2, 5, 250])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(float((i * 7) % 11) - 5, i) for i in range(n)], "a double, b int")
    asked = {"p1": 0.01, "median": 0.5}
    by_all = st.quantiles(st.long_form(df, ["a", "b"]), ["feature"], "value", asked, few_groups=True)
    assert sorted(st.column_quantiles(df, ["a", "b"], asked).collect()) == sorted(by_all.collect())
    assert st.column_quantiles(df, [], asked).collect() == []


def test_preparation_brings_the_bounds_of_its_rows(wide):
    prep = tr.fit_preparation(wide, ["differ", "levels", "none"], [])
    assert prep.bounds == {r.feature: (r.p1, r.p99) for r in feature_bounds(wide, ["differ", "levels"]).collect()}
    assert prep.medians["none"] == 0.0 and prep.medians["levels"] == 3.0


def test_work_overlaps_and_results_keep_their_order(spark):
    meet = Barrier(2, timeout=60)

    def piece(n):
        meet.wait()
        return spark.range(n).count()

    assert side_by_side([lambda n=n: piece(n) for n in (5, 3)], 2) == [5, 3]
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: 1, lambda: 1 // 0])


def test_batch_score_computes_the_months_once(spark, monkeypatch):
    words = ["household_id", "state", "region_type", "age_group", "occupation_group", "education_group", "gender_group",
             "household_size_group", "gender_hh_mode", "occupation_type_hh_mode", "education_level_hh_mode"]
    labels = [*fv.STRESS_LABELS, fv.COMPOSITE_LABEL]
    rows = spark.range(30).select(F.expr("date_add(date'1999-12-01', cast(id as int) * 3)").alias("month_slot"),
                                  *[F.col("id").cast("string").alias(c) for c in words], *[(F.col("id") % 2).alias(c) for c in labels],
                                  *[F.lit(1.0).alias(c) for c in fv.NUMERIC_FEATURES + AMOUNTS if c not in words])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    household = rows.mapInPandas(count, rows.schema)
    tables = SimpleNamespace(spark=spark, household=household)
    given, fitted = [], []
    monkeypatch.setattr(queries, "published", lambda *_: None)
    monkeypatch.setattr(queries, "fit_and_publish", lambda t, label, train, *_: fitted.append((label, train.count())) or label)
    monkeypatch.setattr(queries, "batch_score", lambda profiles, models, composite, explained: given.append(
        (profiles.count(), models, composite)) or profiles.withColumns({c: F.lit(0.0) for c in [*labels, "stress_level", "is_stressed"]}).withColumns(
        {c: F.array().cast("array<string>") for c in ["stressed_domains", "input_warnings", *[f"{x}_drivers" for x in fv.STRESS_LABELS]]}))
    assert queries.score_profiles(tables).count() == 30
    assert given == [(30, {x: x for x in fv.STRESS_LABELS}, fv.COMPOSITE_LABEL)]
    assert sorted(label for label, _ in fitted) == sorted(labels) and len({n for _, n in fitted}) == 1
    assert seen.value == 30 and survey_views.profiles_of(household).columns[:2] == ["household_id", "month_slot"]


AMOUNTS = ["total_income", "total_expenditure_adjusted", "exp_food_adjusted", "exp_all_emis", "exp_health", "exp_education",
           "exp_recreation", "exp_vacation", "exp_restaurants_adjusted", "income_all_members_from_wages", "income_household_from_rent",
           "income_household_from_self_production", "income_household_from_private_transfers", "income_household_from_business_profit",
           "is_hospitalised_hh_any", "is_on_regular_medication_hh_any", "has_bank_account_hh_any", "has_health_insurance_hh_any",
           "has_life_insurance_hh_any", "has_provident_fund_account_hh_any", "has_credit_card_hh_any", "has_demat_account_hh_any",
           "has_mobile_phone_hh_any", "num_members", "age_years_hh_mean", "education_rank_hh_max"]
AMOUNTS = [c for c in AMOUNTS if c not in fv.NUMERIC_FEATURES]
