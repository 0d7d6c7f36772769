"""Models saved by one session and used by another, and the trees as arrays."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.plans import training as tr
from hearthline.plans.model_store import ModelFolder, fingerprint, load_model, save_model
from hearthline.plans.scoring import input_warnings
from hearthline.plans.trees import explain, read_trees

ROOT = Path(__file__).resolve().parents[1]
KEY = ["household_id"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        emi = float(rng.random())
        rows.append((f"h{i}", emi if i % 7 else None, float(rng.random()), ["Goa", "Delhi", None][i % 3], int(emi > 0.6), i % 4))
    return spark.createDataFrame(rows, "household_id string, emi_to_income_ratio double, savings_proxy double, state string, "
                                       "debt_stress int, composite_stress_score int")


@pytest.fixture(scope="module")
def model(frame):
    return tr.train_stress_classifier(frame, "debt_stress", KEY, rounds=4, depth=3)


def scores(model, frame):
    return {r.household_id: r.p for r in model.score(frame, "p").select("household_id", "p").collect()}


NEW_SESSION = """
import sys
from hearthline.plans.model_store import ModelFolder
from hearthline.session import local_session
spark = local_session("second", 2, 2)
model = ModelFolder(spark, sys.argv[1]).load("debt_stress")
model.score(spark.read.parquet(sys.argv[2]), "p").select("household_id", "p").write.parquet(sys.argv[3])
"""


def test_a_new_session_scores_alike(spark, frame, model, tmp_path):
    folder = ModelFolder(spark, str(tmp_path / "models"))
    bounds = spark.createDataFrame([("emi_to_income_ratio", 0.1, 0.9)], "feature string, p1 double, p99 double")
    loaded = folder.publish(model, "v1", fingerprint(frame), 4, 3, bounds)
    before = scores(model, frame)
    assert scores(loaded, frame) == before and loaded.bounds == {"emi_to_income_ratio": (0.1, 0.9)}
    assert (loaded.prep.features, loaded.prep.modes, loaded.scale_pos_weight) == (model.prep.features, model.prep.modes, model.scale_pos_weight)
    assert loaded.prep.neutral("state") == model.prep.neutral("state")
    frame.write.parquet(str(tmp_path / "rows"))
    subprocess.run([sys.executable, "-c", NEW_SESSION, str(tmp_path / "models"), str(tmp_path / "rows"), str(tmp_path / "out")],
                   check=True, cwd=ROOT, timeout=300, capture_output=True)
    assert {r.household_id: r.p for r in spark.read.parquet(str(tmp_path / "out")).collect()} == before


def test_versions(spark, frame, model, tmp_path):
    folder = ModelFolder(spark, str(tmp_path))
    assert folder.load("debt_stress") is None and folder.load_all(fv.STRESS_LABELS) == {}
    folder.publish(model, "v1", "a", 4, 3)
    folder.publish(model, "v2", "b", 4, 3)
    assert folder.version_in_force("debt_stress") == "v2" and folder.version_in_force("debt_stress", "a") == "v1"
    assert folder.version_in_force("debt_stress", least_rounds=5) is None
    folder.back_to("debt_stress", "v1")
    assert folder.version_in_force("debt_stress") == "v1" and set(folder.load_all(fv.STRESS_LABELS)) == {"debt_stress"}
    with pytest.raises(ValueError):
        folder.publish(model, "v1", "a", 4, 3)
    with pytest.raises(ValueError):
        folder.back_to("debt_stress", "v9")


def test_an_unfinished_version_is_not_in_force_and_can_be_written_again(spark, model, tmp_path):
    folder = ModelFolder(spark, str(tmp_path))
    save_model(model, folder.path("debt_stress", "v1"))  # the job died before it pointed at the version
    assert folder.load("debt_stress") is None
    assert folder.publish(model, "v1", "a", 4, 3).prep.features == model.prep.features


def test_regressors_are_saved_too(spark, frame, tmp_path):
    fitted = tr.train_composite_regressor(frame, rounds=2, depth=2)
    save_model(fitted, str(tmp_path / "m"))
    assert scores(load_model(spark, str(tmp_path / "m")), frame) == scores(fitted, frame)


def test_fingerprints_see_rows_and_not_their_order(spark, frame):
    assert fingerprint(frame) == fingerprint(frame.orderBy("household_id").repartition(5))
    assert fingerprint(frame) != fingerprint(frame.limit(299)) != fingerprint(frame.limit(0))


def brute_shares(trees, row):
    shares = np.zeros(len(row))
    for node in trees.roots.tolist():
        while trees.feature[node] >= 0:
            f = trees.feature[node]
            child = trees.left[node] if row[f] <= trees.threshold[node] else trees.right[node]
            shares[f] += trees.value[child] - trees.value[node]
            node = child
    return shares


def test_shares_add_up_to_the_models_own_margin(spark, frame, model, tmp_path):
    save_model(model, str(tmp_path / "m"))
    trees = read_trees(spark, str(tmp_path / "m" / "trees"))
    rows = tr.row_shares(model, frame, KEY).collect()
    own = scores(model, frame)
    x = {r.household_id: np.array(r.x) for r in tr.prepare(frame, model.prep).select("household_id", "x").collect()}
    for r in rows:
        assert r.margin == pytest.approx(r.bias + sum(r.shares), abs=1e-12)
        assert r.probability == pytest.approx(own[r.household_id], abs=1e-12)
        assert r.shares == pytest.approx(brute_shares(trees, x[r.household_id]).tolist(), abs=1e-12)
    assert len(rows) == 300 and tr.row_shares(model, frame.limit(0), KEY).count() == 0


def test_explaining_keeps_other_columns(spark, model):
    df = spark.sql("select 1 as a, named_struct('b', array(1, 2), 'c', timestamp '2024-01-01 00:00:00') as s, "
                   f"array_repeat(0.5d, {len(model.prep.features)}) as x")
    out = explain(df, model.flat(spark)).first()
    assert out.a == 1 and out.s.b == [1, 2] and len(out.shares) == len(model.prep.features)


def test_driver_sentences(spark):
    df = spark.createDataFrame([(50000.0, 51250.4, 12000.0, 8000.0, 4), (0.0, 10.0, 0.0, 0.0, 0)],
                               "i double, e double, f double, m double, n int")
    said = tr.driver_sentences(*map(F.col, "iefmn"))
    names = [*said, "state"]
    first, second = df.select(*[tr.driver_sentence(F.lit(n), said).alias(n) for n in names]).collect()
    assert list(first) == ["Food expense is 23% of total spending", "Monthly savings buffer is ₹-1,250", "EMI is 16% of income",
                           "Health spend is high relative to budget", "Wage income: ₹50,000/month", "Family of 4 on ₹50,000/month",
                           "State is a key driver"]
    assert second.age_years_hh_mean == "Age Years Hh Mean is a key driver"


def test_input_warnings(spark):
    df = spark.createDataFrame([(5.0, 0.5), (None, 2.0), (1.0, 1.0)], "a double, b double")
    found = [r.w for r in df.select(input_warnings({"b": (0.0, 1.0), "a": (0.0, 1.0)}).alias("w")).collect()]
    assert found == [["a=5.00 outside expected range [0.00, 1.00] (training p1-p99)"],
                     ["b=2.00 outside expected range [0.00, 1.00] (training p1-p99)"], []]
    assert df.select(input_warnings({}).alias("w")).first().w == []
