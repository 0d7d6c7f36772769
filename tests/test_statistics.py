"""Distributed order statistics, metrics, sampling, neighbours and drift, against numpy."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from hearthline.operators import metrics as m
from hearthline.operators import profile
from hearthline.operators import sampling as sm
from hearthline.operators.alerts import silence_detector, sustained_condition
from hearthline.operators.neighbours import nearest_neighbours, smote_oversample
from hearthline.operators.order_stats import quantiles, running_totals
from hearthline.operators.profile import null_profile
from hearthline.plans import drift as d


@pytest.fixture(scope="module")
def skewed():
    """A third of all values are one value."""
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(size=2000).round(3), np.full(1000, 0.25)])


def test_quantiles_with_a_hot_value(spark, skewed):
    df = spark.createDataFrame([("g", float(v)) for v in skewed] + [("g", None), ("h", 3.0)], "g string, v double")
    out = {r.g: r for r in quantiles(df, ["g"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}).collect()}
    assert (out["g"].lo, out["g"].mid, out["g"].hi) == pytest.approx(tuple(np.quantile(skewed, [0.01, 0.5, 0.99])))
    assert out["h"].mid == 3.0


def test_running_totals_and_next_value(spark):
    rows = [("g", float(i), i % 5 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    out = running_totals(df, ["g"], "v", ["n"], buckets=8).orderBy("v").collect()
    assert [r.cum_n for r in out] == list(np.cumsum([n for _, _, n in rows]))
    assert [r.next_value for r in out] == [float(i) for i in range(1, 500)] + [None]


def test_auc_equals_the_built_in(spark):
    rng = np.random.default_rng(3)
    score = rng.random(800).round(2)
    label = (rng.random(800) < score).astype(int)
    df = spark.createDataFrame([("a", float(s), int(y)) for s, y in zip(score, label)], "g string, s double, y int")
    mine = m.auc_roc(df, "s", "y", ["g"]).first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(
        df.withColumn("y", F.col("y").cast("double")))
    assert mine == pytest.approx(theirs, abs=1e-9)


def test_confusion_and_report(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 1)] * 5
    df = spark.createDataFrame(rows, "a int, p int")
    cells = {(r.actual, r.predicted): r.n for r in m.confusion_matrix(df, "a", "p", range(3)).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 65 and cells[1, 0] == 0
    report = {r["class"]: r for r in m.classification_report(df, "a", "p", range(3)).collect()}
    assert report["1"].recall == 1.0 and report["1"].precision == pytest.approx(1 / 3)
    assert report["2"].f1 == 0.0 and report["accuracy"].f1 == pytest.approx(55 / 65)


def test_half_to_even_class(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(m.composite_class(F.col("v"))).collect()] == [2, 4, 0, 4]


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("g"))
    out = sm.hash_rank(df, ["g"], ["id"]).groupBy("g").agg(
        F.min("hash_rank").alias("lo"), F.max("hash_rank").alias("hi"), F.countDistinct("hash_rank").alias("n"),
        F.max("group_rows").alias("rows"))
    assert {(r.g, r.lo, r.hi, r.n, r.rows) for r in out.collect()} == {("a", 1, 2500, 2500, 2500), ("b", 1, 500, 500, 500)}


def test_capped_sample(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 990, "a").otherwise("b").alias("month_slot"))
    out = sm.capped_sample_per_month(df, ["id"], max_rows=100)
    assert {r.month_slot: r["count"] for r in out.groupBy("month_slot").count().collect()} == {"a": 50, "b": 10}


def test_split_method_is_the_callers(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"),
                                 F.lit("2024-01-01").cast("date").alias("month_slot"))
    out = {(r.y, r.split): r["count"] for r in sm.temporal_split(df, "y", ["id"], method="stratified").groupBy("y", "split").count().collect()}
    assert out == {(0, "test"): 15, (0, "train"): 60, (1, "test"): 5, (1, "train"): 20}
    few = sm.temporal_split(df.limit(3), "y", ["id"]).select("split", "split_method").distinct().collect()
    assert [tuple(r) for r in few] == [("test", "temporal")]


def brute_force(points, k):
    x = np.array([p for _, p in points])
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(distance, np.inf)
    return np.sort(distance, axis=1)[:, :k]


def test_copies_of_a_vector_are_bounded_in_large_tables():
    from hearthline.operators.neighbours import BLOCKS, MOST_ROWS, rows_of_block

    assert rows_of_block(256, 1000) == 256
    assert 1_000_000 / rows_of_block(256, 1_000_000) <= BLOCKS
    assert rows_of_block(256, 10 ** 9) == MOST_ROWS


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1.0, 1e6), (1e-3, 0.0), (1e8, 3.0)])
def test_matrix_products_choose_the_neighbours_that_distances_choose(scale, shift):
    import pandas as pd

    from hearthline.operators.neighbours import _closest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) * scale + shift
    x[50:120], x[120:140], x[140, 3], x[141, 3] = x[5], x[5] + scale * 1e-7, np.nan, np.inf
    frame = pd.DataFrame({"id": [str(i) for i in range(300)], "vector": list(x), "reach": [0.5 * scale] * 30 + [np.nan] * 270})
    expected = []
    for i in range(300):
        distance = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        distance[i] = np.inf
        best = np.lexsort((frame["id"], distance))[:4]
        expected += [(str(i), str(j), distance[j]) for j in best if np.isfinite(distance[j]) and (i >= 30 or distance[j] <= 0.5 * scale)]
    assert list(_closest(frame, frame, 4).itertuples(index=False, name=None)) == expected


def test_neighbours_are_exact_even_with_many_copies(spark):
    rng = np.random.default_rng(5)
    points = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(i, [0.1, 0.2, 0.3, 0.4]) for i in range(200, 300)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    found = {int(r.query_id): [n.distance for n in r.neighbours] for r in nearest_neighbours(
        df, "id", "v", 3, pivots=6, block_rows=32, query_rows=64).collect()}
    expected = brute_force(points, 3)
    assert len(found) == 300
    for (i, _), row in zip(points, expected):
        assert found[i] == pytest.approx(row.tolist(), abs=1e-9)


def test_smote_only_when_rare_and_up_to_the_target(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist(), int(i < 6)) for i in range(406)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    out = smote_oversample(df, "y", "id", "x", ratio=0.1, trigger=50.0, k=3)
    counts = {(r.y, r.synthetic): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, False): 400, (1, False): 6, (1, True): 34}
    box = np.array([x for i, x, _ in rows if i < 6])
    for r in out.filter("synthetic").collect():
        assert (np.array(r.x) >= box.min(axis=0) - 1e-9).all() and (np.array(r.x) <= box.max(axis=0) + 1e-9).all()
    assert smote_oversample(df, "y", "id", "x", trigger=100.0).filter("synthetic").count() == 0


def test_poisson_weights(spark):
    w = spark.range(20000).select(sm.poisson_one(sm.uniform(["id"], 1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1.0, abs=0.03) and w[1] == pytest.approx(1.0, abs=0.06)


def test_numeric_drift_against_numpy(spark):
    rng = np.random.default_rng(2)
    base, cur = rng.normal(size=1500).round(3), rng.normal(0.5, 1, size=900).round(3)
    row = d.numeric_drift(spark.createDataFrame([(float(v),) for v in base], "v double"),
                          spark.createDataFrame([(float(v),) for v in cur] + [(None,)], "v double"), ["v"]).first()
    grid = np.union1d(base, cur)
    f1 = np.searchsorted(np.sort(base), grid, side="right") / len(base)
    f2 = np.searchsorted(np.sort(cur), grid, side="right") / len(cur)
    assert row.ks == pytest.approx(np.abs(f1 - f2).max())
    area = (np.abs(f1 - f2)[:-1] * np.diff(grid)).sum()
    assert row.wasserstein == pytest.approx(area / base.std()) and row.drifted


def test_drift_of_equal_sides_is_none(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(200)], "v double, c string")
    numeric = d.numeric_drift(df, df, ["v"])
    assert numeric.first().ks == 0.0 and not numeric.first().drifted
    categorical = d.categorical_drift(df, df, ["c"])
    assert categorical.first().js_distance == pytest.approx(0.0)
    share = d.drift_share(numeric, categorical).first()
    assert (share.columns, share.drift_share, share.alert) == (2, 0.0, False)


def test_decision_reasons(spark):
    share = spark.createDataFrame([(0.5,)], "drift_share double")
    rate = spark.createDataFrame([(0.6,)], "stress_rate double")
    row = d.retrain_decision(share, rate).first()
    assert row.retrain and row.reasons == "dataset drift 50.00% > 30%; stress rate shift 18.00% > 15%"


def test_silence_and_sustained(spark):
    df = spark.createDataFrame([("a", s) for s in (0, 10, 100, 131, 132)], "k string, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    gaps = silence_detector(df, ["k"], 30, "ts").orderBy("gap_start_us").collect()
    assert [g.gap_seconds for g in gaps] == [90.0, 31.0]
    series = spark.createDataFrame([("d", b, f) for b, f in ((0, True), (60, True), (120, False), (180, True), (300, True))],
                                   "domain string, bucket long, firing boolean")
    runs = sustained_condition(series, 60, 120).collect()
    assert [(r.run_start, r.run_end, r.buckets) for r in runs] == [(0, 120, 2)]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    row = null_profile(df).first()
    assert row.missing == 2 and row.flagged
    empty = null_profile(df.limit(0)).first()
    assert (empty.missing, empty.missing_pct) == (0, 0.0)


def test_an_outage_fires_and_becomes_an_alert(spark):
    from hearthline.operators import alerts as al

    start = 1704067200
    rows = [(start + 300 * b + k, "d") for b in [*range(11), 16] for k in range(100)]
    df = spark.createDataFrame(rows, "s long, domain string").selectExpr("timestamp_seconds(s) AS assessed_at", "domain")
    out = {(r.bucket - start) // 300: (r.n, r.firing, r.alert) for r in al.volume_drop_alert(df).collect()}
    assert [out[b] for b in (10, 11, 12, 13)] == [
        (100, False, False), (0, True, False), (0, True, False), (0, True, True)]
    assert not out[16][1]


def test_prevalence_at_every_level(spark):
    rows = [("a", "x", 1), ("a", "y", 0), ("b", None, 1), ("b", None, None)]
    df = spark.createDataFrame(rows, "state string, region string, l int")
    found = {(r.depth, r.state, r.region): (r.positives, r.n_rows, r["mean"]) for r in
             profile.prevalence_rollup(df, ["state", "region"], ["l"]).collect()}
    assert found == {(0, None, None): (2, 3, 2 / 3), (1, "a", None): (1, 2, 0.5), (1, "b", None): (1, 1, 1.0),
                     (2, "a", "x"): (1, 1, 1.0), (2, "a", "y"): (0, 1, 0.0), (2, "b", None): (1, 1, 1.0)}
    assert profile.prevalence_rollup(df.limit(0), ["state"], ["l"]).filter("depth > 0").count() == 0


def test_scorecard_reads_a_table_once(spark):
    one, two = spark.range(10), spark.range(5)
    checks = {"a": (one, F.count("id") == 10), "b": (two, F.max("id") > 4), "c": (one, F.min("id") == 1), "d": (two, F.max(F.lit(None)) > 1)}
    card = profile.quality_scorecard(checks)
    assert {r.check_name: r.passed for r in card.collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert card._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2


def test_raw_against_clean_with_the_age_marker(spark):
    raw = spark.createDataFrame([("1", "-100"), ("2", "30")], "HH_ID string, AGE_YRS string")
    clean = spark.createDataFrame([("1", None), ("2", 30.0)], "household_id string, age_years double")
    row = profile.raw_vs_clean_diff(raw, clean, "POI", -100.0).first()
    assert (row.row_delta, row.sentinels_removed, row.missing_pct_delta) == (0, 1, 25.0)
