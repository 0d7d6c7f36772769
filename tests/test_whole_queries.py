"""Inputs of which an operator or a registered query once did only a part."""

import inspect
import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog import drift, load_registry, training
from hearthline.plans import training as tr
from hearthline.streaming import sessions


def test_metadata_and_typical_level_do_not_depend_on_the_number_of_levels(spark, monkeypatch):
    monkeypatch.setattr(tr, "MAX_MAPPED_LEVELS", 2)
    df = spark.createDataFrame([(1.0, x) for x in "dcbac"], "n double, c string")
    prep = tr.fit_preparation(df, ["n"], ["c"])
    assert prep.neutral("c") == 2.0
    bounds = spark.createDataFrame([("n", 0.0, 1.0)], "feature string, p1 double, p99 double")
    row = tr.model_metadata([tr.StressModel("debt_stress", prep, None)], bounds, "2020-01-01", "v", spark).first()
    assert json.loads(row.levels) == {"c": ["a", "b", "c", "d"]}


@pytest.mark.parametrize("name", ["top_features", "feature_importance", "model_metadata", "row_drivers",
                                  "confidence_band", "train_composite_regressor", *[f"train_{c}" for c in fv.STRESS_LABELS]])
def test_registered_queries_train_with_the_defaults(name, monkeypatch):
    class Called(Exception):
        pass

    def instead(f):
        def stand_in(*args, **kwargs):
            given = inspect.signature(f).bind(*args, **kwargs).arguments
            assert not {"rounds", "depth", "bags"} & set(given)
            raise Called
        return stand_in

    for f in ("train_stress_classifier", "train_composite_regressor", "confidence_band"):
        monkeypatch.setattr(tr, f, instead(getattr(tr, f)))
    monkeypatch.setattr(training, "split", lambda t, label: (None, None))
    monkeypatch.setattr(training, "published", lambda *args: None)
    with pytest.raises(Called):
        load_registry()[name].run(None)


def test_all_monitored_columns():
    assert {"income_all_members_from_wages", "emi_to_income_ratio", "food_to_expense_ratio", "health_to_expense_ratio",
            "savings_proxy"} <= set(drift.MONITORED)
    assert {"monitored_numeric_drift", "monitored_drift_share", "monitored_retrain_decision",
            "training_feature_bounds"} <= set(load_registry())


def test_partitions_are_reduced_to_bucket_ends():
    frames = [pd.DataFrame({"domain": ["d"] * 500, "us": range(i * 500, i * 500 + 500)}) for i in range(4)]
    out = pd.concat(sessions.bucket_ends(iter(frames), 1000))
    assert out.values.tolist() == [["d", 0, 999], ["d", 1000, 1999]]


def test_top_features_of_every_classifier(spark, monkeypatch):
    asked = []

    def model_of(t, label, train):
        asked.append((label, train))
        names = [f"{label}_{i:02}" for i in range(12)]
        return SimpleNamespace(label=label, prep=SimpleNamespace(features=names),
                               model=SimpleNamespace(featureImportances=Vectors.dense(range(12))))

    monkeypatch.setattr(training, "split", lambda t, label: (f"rows of {label}", None))
    monkeypatch.setattr(training, "model_of", model_of)
    rows = load_registry()["top_features"].run(SimpleNamespace(spark=spark)).collect()
    assert sorted(asked) == sorted((label, f"rows of {label}") for label in fv.STRESS_LABELS)
    for label in fv.STRESS_LABELS:
        top = sorted((r.rank, r.feature) for r in rows if r.model == label)
        assert top == [(i + 1, f"{label}_{11 - i:02}") for i in range(10)]


def test_driver_sentences_name_the_members(spark, monkeypatch):
    test = spark.createDataFrame([("h1", "2000-01-01", 1000.0, 900.0, 300.0, 0.0, 4), ("h2", "2000-01-01", None, 900.0, 300.0, 0.0, 4)],
                                 "household_id string, month_slot string, total_income double, total_expenditure_adjusted double, "
                                 "exp_food_adjusted double, exp_all_emis double, num_members long")
    found = test.select("household_id", "month_slot", F.lit(0.5).alias("probability"), F.array(F.struct(
        F.lit("age_years_hh_mean").alias("feature"), F.lit(1.0).alias("delta"))).alias("drivers"))
    monkeypatch.setattr(training, "split", lambda t, label: (None, test))
    monkeypatch.setattr(training, "model_of", lambda *_: None)
    monkeypatch.setattr(tr, "row_drivers", lambda *_: found)
    said = {r.household_id: r.drivers for r in load_registry()["row_drivers"].run(None).collect()}
    assert said == {"h1": "Family of 4 on ₹1,000/month", "h2": "Age Years Hh Mean is a key driver"}
