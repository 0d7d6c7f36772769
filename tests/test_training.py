"""Preparation, boosted trees and explanations on a small frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.plans import training as tr


def test_preparation_follows_median_mode_and_population_scale(spark):
    df = spark.createDataFrame([(1.0, "b", None), (2.0, "a", None), (3.0, None, None), (10.0, "b", None), (None, "c", None)],
                               "n double, c string, empty double")
    prep = tr.fit_preparation(df, ["n", "empty"], ["c"])
    assert prep.medians == {"n": 2.5, "empty": 0.0} and prep.modes["c"] == "b" and prep.levels["c"] == ["a", "b", "c"]
    filled = np.array([1, 2, 3, 10, 2.5])
    rows = [r.x for r in tr.prepare(df, prep).collect()]
    assert [x[0] for x in rows] == pytest.approx(((filled - filled.mean()) / filled.std()).tolist())
    assert [x[1] for x in rows] == [0.0] * 5 and [x[2] for x in rows] == [1.0, 0.0, 1.0, 1.0, 2.0]
    unknown = tr.prepare(spark.createDataFrame([(1.0, "zz", 1.0)], "n double, c string, empty double"), prep).first().x
    assert unknown[2] == -1.0


def test_long_level_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tr, "MAX_MAPPED_LEVELS", 2)
    df = spark.createDataFrame([(1.0, x) for x in "dcba"], "n double, c string")
    prep = tr.fit_preparation(df, ["n"], ["c"])
    assert not prep.levels and {r.c: r.x[1] for r in tr.prepare(df, prep).collect()} == dict(a=0.0, b=1.0, c=2.0, d=3.0)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        emi = float(rng.random())
        rows.append((f"h{i}", emi, float(rng.random()), ["Goa", "Delhi"][i % 2], int(emi > 0.6)))
    return spark.createDataFrame(rows, "household_id string, emi_to_income_ratio double, savings_proxy double, state string, debt_stress int")


def test_classifier_learns_and_explains(spark, frame):
    model = tr.train_stress_classifier(frame, "debt_stress", ["household_id"], rounds=3, depth=2)
    metrics = tr.evaluate_binary(model.score(frame, "probability"), "debt_stress", "probability").first()
    assert metrics.auc > 0.95 and metrics.n_test == 400
    top = tr.top_features(tr.feature_importance(model, spark), 1).first()
    assert top.feature == "emi_to_income_ratio"
    drivers = tr.row_drivers(model, frame, ["household_id"], 2)
    assert drivers.count() == 400
    assert drivers.filter(F.col("drivers")[0]["feature"] == "emi_to_income_ratio").count() > 300
    excluded = tr.train_stress_classifier(frame.withColumnRenamed("debt_stress", "financial_stress"), "financial_stress",
                                          ["household_id"], rounds=1, depth=1)
    assert "savings_proxy" not in excluded.prep.features


def test_bagged_confidence(spark, frame):
    banded = tr.confidence_band(frame, frame, "debt_stress", ["household_id"], bags=2, rounds=1, depth=1)
    row = banded.agg(F.max("std"), F.countDistinct("confidence")).first()
    assert row[0] >= 0 and row[1] >= 1


def test_row_weights_survive_oversampling(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"h{i}", float(rng.random()), float(i % 3), int(i % 100 == 0)) for i in range(600)]
    rare = spark.createDataFrame(rows, "household_id string, emi_to_income_ratio double, savings_proxy double, debt_stress int")
    seen = {}

    class Caught(Exception):
        pass

    class Fit:
        def fit(self, df):
            seen["rows"] = df.collect()
            raise Caught

    monkeypatch.setattr(tr, "_classifier", lambda rounds, depth: Fit())
    with pytest.raises(Caught):
        tr.train_stress_classifier(rare, "debt_stress", ["household_id"], row_weight=F.col("savings_proxy") + 1)
    positive = [r for r in seen["rows"] if r.label == 1.0]
    assert len(positive) > 6 and len(seen["rows"]) - len(positive) == 594
    weights = {round(r.weight, 6) for r in positive}
    assert weights <= {round(99.0 * k, 6) for k in (1, 2, 3)} and len(weights) == 3
    assert {r.weight for r in seen["rows"] if r.label == 0.0} == {1.0, 2.0, 3.0}


def test_gate(spark):
    old = spark.createDataFrame([("a", 0.90), ("b", 0.90)], "model string, f1_macro double")
    new = spark.createDataFrame([("a", 0.89), ("b", 0.87)], "model string, f1_macro double")
    assert {r.model: r.accepted for r in tr.model_gate(old, new).collect()} == {"a": True, "b": False}


def test_fixed_lists_are_consistent():
    assert set(fv.EXCLUDED_FEATURES) == {*fv.STRESS_LABELS, fv.COMPOSITE_LABEL}


def test_rows_of_a_fit_are_dealt_evenly(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).repartitionByRange(3, F.when(F.col("id") < 3990, 0).otherwise(F.col("id")))
    assert tr.dealt_evenly(rows, 4000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()  # too few to matter
    monkeypatch.setattr(tr, "EVEN_FROM", 4000 // cores)
    sizes = [len(part) for part in tr.dealt_evenly(rows, 4000).rdd.glom().collect()]
    assert len(sizes) == cores and sum(sizes) == 4000 and max(sizes) - min(sizes) <= 2 * rows.rdd.getNumPartitions()
    monkeypatch.setattr(tr, "PART_ROWS", 4000 // cores - 1)
    assert tr.dealt_evenly(rows, 4000).rdd.getNumPartitions() == 2 * cores


def test_classifiers_and_regressor_fit_on_rows_dealt_evenly(spark, frame, monkeypatch):
    monkeypatch.setattr(tr, "EVEN_FROM", 1)
    seen = []
    real = tr.dealt_evenly
    monkeypatch.setattr(tr, "dealt_evenly", lambda df, rows: seen.append((real(df, rows).rdd.getNumPartitions(), rows)) or real(df, rows))
    tr.train_stress_classifier(frame, "debt_stress", ["household_id"], rounds=1, depth=1)
    tr.train_composite_regressor(frame.withColumnRenamed("debt_stress", fv.COMPOSITE_LABEL), rounds=1, depth=1)
    assert seen == [(spark.sparkContext.defaultParallelism, 400)] * 2
