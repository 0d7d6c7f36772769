"""Free-text answers."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions import answers as an


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    assert one(spark, an.parse_amount, "₹1,23,456", "1.5 lakh", "2L", "20k", "5000 rupees", "none", "", "-300", "2 large", "12 l") == [
        123456.0, 150000.0, 200000.0, 20000.0, 5000.0, 0.0, 0.0, 300.0, 2.0, 1200000.0]


def test_yes(spark):
    assert one(spark, an.parse_yes, " YES ", "haan", "ji han", "no", "1", "yes please") == [True, True, True, False, True, False]


def test_region_and_health(spark):
    assert one(spark, an.parse_region, "Urban", "METRO city", "village") == ["URBAN", "URBAN", "RURAL"]
    assert one(spark, an.parse_hospitalised, "Hospitalised", "both", "medicine") == [True, True, False]
    assert one(spark, an.parse_medication, "Medication", " Both ", "neither") == [True, True, False]


@pytest.mark.parametrize("text", ["self-employed", "DAILY wage", "owner's son", "uttar pradesh", "a1b é-x", ""])
def test_title_case_is_pythons(spark, text):
    assert one(spark, an.title_case, text) == [text.title()]


def test_clamps(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.9,), (200.0,)], "n double")
    got = df.select(an.clamp_members(F.col("n")), an.clamp_age(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(1, 40), (1, 40), (2, 18), (200, 90)]


def test_profile_ignores_answers_after_the_last_step(spark):
    rows = [("s", i, "5 people" if i == 2 else f"answer {i}") for i in range(1, 18)]
    df = spark.createDataFrame(rows, "session string, message_id int, text string")
    row = an.profile_from_answers(an.answer_steps(df)).first()
    assert row.completed and row.num_members == 5 and row.age_head == 18


def test_bands_and_levels(spark):
    df = spark.createDataFrame([(None, None), (0.29, 0), (0.3, 2), (0.6, 7)], "p double, n int")
    got = df.select(an.risk_band(F.col("p")), an.level_label(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("N/A", "None"), ("Low Risk", "None"), ("Moderate", "Moderate"), ("High Risk", "Severe")]


def test_ratios_without_income(spark):
    df = spark.createDataFrame([(0.0, 5.0), (100.0, 0.0), (100.0, 150.0)], "i double, e double")
    ratios = an.household_ratios(F.col("i"), F.col("e"), F.lit(1.0), F.lit(None).cast("double"))
    rows = df.select(*[c.alias(n) for n, c in ratios.items()]).collect()
    assert tuple(rows[0]) == (None, None, None, None)
    assert rows[1].food_to_expense_pct is None and rows[2].monthly_savings == 0.0 and rows[2].emi_to_income_pct == 0.0
