"""Stored quantile sketches against exact ranks and distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import sketches as sk

SCHEMA = "month_slot string, a double, b double, empty double"


def frame(spark, rng, months, n, shift=0.0):
    rows = []
    for m in months:
        for v in rng.normal(shift, 1.0, n).tolist():
            rows.append((m, v, float(rng.integers(0, 5)) if v > -1 else None, None))
    rows.append((months[0], float("nan"), None, None))
    return spark.createDataFrame(rows, SCHEMA)


def rank_gap(values, found, p):
    """How far p lies from the ranks that `found` has."""
    low, high = np.mean(values < found), np.mean(values <= found)
    return max(0.0, low - p, p - high)


def test_merged_sketches_keep_the_rank_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    store = sk.SketchStore(spark, str(tmp_path))
    assert store.merged().count() == 0
    first, second = frame(spark, rng, ["2020-01", "2020-02"], 8000), frame(spark, rng, ["2020-03"], 8000, 1.0)
    store.add(first, ["a", "b", "empty"])
    store.add(second, ["a", "b", "empty"])
    probabilities = {f"p{p}": p / 100 for p in (1, 10, 50, 90, 99)}
    for rows, of in ((first, F.col("month") < "2020-03"), (first.union(second), None)):
        found = {r.feature: r for r in sk.sketch_quantiles(store.merged(of), probabilities).collect()}
        assert set(found) == {"a", "b"}
        for c in ("a", "b"):
            values = np.array([r[c] for r in rows.select(c).collect() if r[c] is not None and r[c] == r[c]])
            assert found[c].n == len(values)
            assert all(rank_gap(values, found[c][name], p) <= 2 * sk.RANK_ERROR for name, p in probabilities.items())


def test_a_month_that_comes_again_replaces_its_sketches(spark, tmp_path):
    rng = np.random.default_rng(2)
    store = sk.SketchStore(spark, str(tmp_path))
    store.add(frame(spark, rng, ["2020-01", "2020-02"], 100), ["a"])
    store.add(frame(spark, rng, ["2020-02"], 30), ["a"])
    assert {r.month: r.n for r in store.months().collect()} == {"2020-01": 100, "2020-02": 30}


@pytest.mark.parametrize("shift", [0.0, 0.1, 2.0])
def test_drift_is_near_the_exact_distance(spark, tmp_path, shift):
    rng = np.random.default_rng(3)
    store = sk.SketchStore(spark, str(tmp_path))
    before, after = frame(spark, rng, ["2020-01"], 6000), frame(spark, rng, ["2020-02"], 6000, shift)
    for df in (before, after):
        store.add(df, ["a", "b"])
    found = {r.feature: r for r in sk.sketch_drift(store.merged(F.col("month") == "2020-01"), store.merged(F.col("month") == "2020-02")).collect()}
    for c in ("a", "b"):
        x, y = (np.sort([r[c] for r in df.select(c).collect() if r[c] is not None and r[c] == r[c]]) for df in (before, after))
        points = np.concatenate([x, y])
        exact = np.abs(np.searchsorted(x, points, "right") / len(x) - np.searchsorted(y, points, "right") / len(y)).max()
        assert abs(found[c].ks - exact) <= 2 * sk.RANK_ERROR + 2 / sk.GRID
        assert found[c].n_base == len(x) and found[c].psi >= 0
    assert (found["a"].psi > 0.25) == (shift == 2.0)
