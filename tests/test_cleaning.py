"""Cleaning operators on the odd values real survey files hold."""

import datetime as dt

from hearthline import fixed_values as fv
from hearthline.operators import cleaning as c


def test_numbers_and_sentinels(spark):
    texts = ["12", " 12.5 ", "-99", "-99.0", "abc", "NaN", "12d", "", "1e3", ".5", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string")
    out = c.sentinel_to_null(c.to_numeric_coerce(df, ["v"]), ["v"], fv.MONEY_SENTINEL)
    got = [r.v for r in out.orderBy("i").collect()]
    assert got == [12.0, 12.5, None, None, None, None, None, None, 1000.0, 0.5, None]


def test_string_nulls_match_exactly(spark):
    texts = [*fv.STRING_NULLS, "dk", " DK", "Graduate", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string")
    got = [r.v for r in c.string_null_to_null(df).orderBy("i").collect()]
    assert got == [None] * len(fv.STRING_NULLS) + ["dk", " DK", "Graduate", None]


def test_month_slot(spark):
    df = spark.createDataFrame([("Jan 2014",), ("JAN 2014",), ("2014-01",), (None,)], "month_slot string")
    first = dt.date(2014, 1, 1)
    assert [r[0] for r in c.parse_month_slot(df).collect()] == [first, first, None, None]


def test_yes_no_and_education(spark):
    df = spark.createDataFrame([(" y ", "Illiterate"), ("N", "Doctorate"), ("maybe", "graduate"), (None, None)],
                               "has_bank_account string, education_level string")
    out = c.education_rank(c.yn_to_int(df, ["has_bank_account"])).collect()
    assert [r.has_bank_account for r in out] == [1, 0, None, None]
    assert [r.education_rank for r in out] == [0, 10, None, None]


def test_accepted_only_where_a_status_exists(spark):
    df = spark.createDataFrame([("a", "Accepted"), ("b", "accepted"), ("c", None)], "HH_ID string, RESPONSE_STATUS string")
    assert [r.HH_ID for r in c.filter_accepted(df).collect()] == ["a"]
    assert c.filter_accepted(df.drop("RESPONSE_STATUS")).count() == 3


def test_composed_cleaners_keep_known_columns_only(spark):
    inc = spark.createDataFrame([("h", "Jan 2020", "-99", "x", "Accepted")],
                                "HH_ID string, MONTH_SLOT string, TOT_INC string, EXTRA string, RESPONSE_STATUS string")
    out = c.clean_inc(inc)
    assert out.columns == ["household_id", "month_slot", "total_income"]
    assert out.first().total_income is None
    assert len(fv.INC_KEEP) == 19 and len(fv.POI_COLUMNS) == 29 and len(fv.CON_COLUMNS) == 102
    assert len(fv.NUMERIC_FEATURES) == 36 and len(fv.CATEGORICAL_FEATURES) == 9


def test_feature_exclusions():
    assert "savings_proxy" not in c.model_features("financial_stress", fv.NUMERIC_FEATURES)
    assert "savings_proxy" in c.model_features("debt_stress", fv.NUMERIC_FEATURES)
