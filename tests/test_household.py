"""People aggregate, joins, labels and ratios."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.functions import features as ft
from hearthline.functions.labels import compute_labels, compute_ratios, relabel_health_che
from hearthline.operators.joins import join_income_consumption, join_people, match_month_pairs
from hearthline.operators.people import household_mode, poi_household_agg, poi_reaggregate

KEYS = "household_id string, state string, homogeneous_region string, district string, region_type string, stratum string, month_slot date"
JAN = dt.date(2020, 1, 1)


def member(household, member_id, stamp, age, gender=None, hospitalised=None):
    return (household, "Goa", "R", "D", "URBAN", "S", JAN, member_id, stamp, age, gender, hospitalised)


def people(spark, rows):
    return spark.createDataFrame(rows, KEYS + ", member_id string, file_stamp string, age_years double, gender string, is_hospitalised int")


def test_mean_of_means_is_not_the_flat_mean(spark):
    df = people(spark, [member("h", "1", "20200131", 20.0), member("h", "2", "20200131", 40.0),
                        member("h", "3", "20200229", 60.0)])
    out = poi_reaggregate(poi_household_agg(df)).first()
    assert out.age_years_hh_mean == pytest.approx(45.0)  # (30 + 60) / 2, flat mean is 40


def test_first_nonnull_follows_file_then_member(spark):
    df = people(spark, [member("h", "1", "20200131", 20.0, None), member("h", "2", "20200131", 20.0, "F", 0),
                        member("h", "0", "20200229", 20.0, "M", 1)])
    out = poi_reaggregate(poi_household_agg(df)).first()
    assert (out.gender_hh_mode, out.is_hospitalised_hh_any) == ("F", 1)


def test_null_keys_drop_out_of_the_people_aggregate(spark):
    df = people(spark, [member("h", "1", "20200131", 20.0), member(None, "1", "20200131", 20.0)])
    assert poi_household_agg(df).count() == 1


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("h", "b"), ("h", "a"), ("h", None)], "k string, v string")
    assert household_mode(df, ["k"], ["v"]).first().v_mode == "a"


def pair(spark):
    inc = spark.createDataFrame([("h", None, JAN, "Jan 2020", 100.0), ("g", "X", JAN, "Jan 2020", 50.0)],
                                "household_id string, state string, month_slot date, reference_month string, total_income double")
    con = spark.createDataFrame([("h", None, JAN, "Jan 2020", "dup", 120.0)],
                                "household_id string, state string, month_slot date, reference_month string, total_income string, total_expenditure_adjusted double")
    return inc, con


def test_null_keys_match_in_the_month_join_and_left_columns_win(spark):
    out = join_income_consumption(*pair(spark)).collect()
    assert len(out) == 1 and out[0].total_income == 100.0 and out[0].total_expenditure_adjusted == 120.0


def test_people_join_keeps_households_without_people(spark):
    inc, con = pair(spark)
    joined = join_income_consumption(inc, con)
    agg = spark.createDataFrame([("zz", 1)], "household_id string, is_hospitalised_hh_any int")
    out = join_people(joined, agg).collect()
    assert len(out) == 1 and out[0].is_hospitalised_hh_any is None


def test_month_present_in_one_survey_only(spark):
    a = spark.createDataFrame([("20200131",), ("20200229",)], "file_stamp string")
    b = spark.createDataFrame([("20200229",), ("20200331",)], "file_stamp string")
    assert [r[0] for r in match_month_pairs(a, b).collect()] == ["20200229"]


AMOUNTS = "total_income double, total_expenditure_adjusted double, exp_food_adjusted double, exp_all_emis double, is_hospitalised_hh_any int, is_on_regular_medication_hh_any int"


def test_labels_with_null_and_zero_income(spark):
    df = spark.createDataFrame([
        (100.0, 120.0, 80.0, 40.0, 1, 0),      # everything stressed
        (None, 120.0, None, 40.0, None, None),  # unknown is not stressed
        (0.0, 10.0, 5.0, 1.0, 0, 1),            # zero income is finite and huge
        (100.0, 110.0, 55.0, 30.0, 0, 0),       # exactly on the limits
    ], AMOUNTS)
    rows = [tuple(r[c] for c in [*fv.STRESS_LABELS, fv.COMPOSITE_LABEL]) for r in compute_labels(df).collect()]
    assert rows == [(1, 1, 1, 1, 4), (0, 0, 0, 0, 0), (1, 0, 1, 1, 3), (0, 0, 0, 0, 0)]


def test_labels_without_their_columns_are_null_and_count_zero(spark):
    row = compute_labels(spark.createDataFrame([(5.0,)], "total_income double")).first()
    assert row.financial_stress is None and row.health_stress == 0 and row.composite_stress_score == 0


def test_ratios_treat_missing_as_zero(spark):
    df = spark.createDataFrame([(None, 200.0, 50.0)], "total_income double, total_expenditure_adjusted double, exp_health double")
    row = compute_ratios(df).first()
    assert row.savings_proxy == -200.0 and row.health_to_expense_ratio == pytest.approx(0.25)
    assert row.food_to_expense_ratio == 0.0 and row.income_diversity_score == 0


def test_health_share_label(spark):
    df = compute_ratios(compute_labels(spark.createDataFrame(
        [(100.0, 100.0, 60.0, 0.0, 0, 0, 20.0)], AMOUNTS + ", exp_health double")))
    row = relabel_health_che(df).first()
    assert (row.health_stress, row.composite_stress_score) == (1, 2)


def test_engineered_features(spark):
    df = spark.createDataFrame([(4, 20000.0, "village", 0.4, 1, None)],
                               "size int, income double, region string, emi double, hosp int, meds int")
    row = df.select(
        ft.dependents_ratio(F.col("size"), F.col("income")).alias("d"),
        ft.dependents_ratio(F.col("size"), F.lit(0.0)).alias("capped"),
        ft.dependents_ratio(F.col("size"), F.lit(0.0), "serve").alias("unserved"),
        ft.rural_low_income_flag(F.col("region"), F.col("income")).alias("rural"),
        ft.emi_health_interaction(F.col("emi"), F.col("hosp"), F.col("meds")).alias("sick"),
        ft.recency_weight(F.lit("2022-01-01").cast("date")).alias("recent"),
        ft.recency_weight(F.lit(None).cast("date")).alias("undated")).first()
    assert row.d == pytest.approx(2.0) and row.capped == 200.0 and row.unserved is None
    assert (row.rural, row.sick, row.recent, row.undated) == (1, 0.4, 2.0, 1.0)


def test_training_and_scoring_share_one_feature_base(spark):
    df = spark.createDataFrame([(4, 30000.0, 50000.0, "RURAL"), (3, 10000.0, 20000.0, "RURAL")],
                               "num_members int, wages double, total_income double, region_type string")
    row = df.selectExpr("*", "wages AS income_all_members_from_wages", "total_income - 1000 AS savings_proxy",
                        "1000D AS total_expenditure_adjusted", "0 AS has_health_insurance_hh_any", "0D AS health_to_expense_ratio",
                        "0D AS emi_to_income_ratio", "0 AS is_hospitalised_hh_any", "0 AS is_on_regular_medication_hh_any")
    size, income = F.col("num_members"), F.col("total_income")
    both = ft.engineer_features(row).select(
        "dependents_ratio", ft.dependents_ratio(size, income, "serve").alias("served"), "rural_low_income_flag",
        ft.rural_low_income_flag(F.col("region_type"), income).alias("served_flag")).collect()
    assert all(r.dependents_ratio == r.served and r.rural_low_income_flag == r.served_flag for r in both)


def test_tasks_merge_fewer_bytes_than_usual_unless_the_session_says_otherwise(spark):
    from hearthline.session import TASK_BYTES, tune

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    fresh = spark.newSession()
    fresh.conf.unset(name)
    assert tune(fresh).conf.get(name) == TASK_BYTES
    own = spark.newSession()
    own.conf.set(name, "32MB")
    assert tune(own).conf.get(name) == "32MB"
