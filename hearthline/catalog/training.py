"""Queries for training-set preparation, models and their evaluation.

Models train on all rows of months before the cutoff, with the operators' own rounds, depth and bags.
Each `train_*` query fits and publishes its model in the shared model folder; queries about a
model take the published one that was trained on the same rows, or fit and publish it themselves.
`batch_score` only asks for a model of STARTER_ROUNDS rounds: where none is published, five full
fits would take longer than anyone waits for scores.
"""

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import over, text_list
from hearthline.catalog.registry import query, rounded, text
from hearthline.catalog.scoring import KEYS, RAW, with_raw
from hearthline.catalog.survey_views import DEMO_CUTOFF, profiles_of
from hearthline.operators import sampling as sm
from hearthline.operators.neighbours import nearest_neighbours, smote_oversample
from hearthline.operators.profile import feature_bounds
from hearthline.plans import training as tr
from hearthline.plans.model_store import BOUNDS, ModelFolder, fingerprint
from hearthline.plans.scoring import batch_score
from hearthline.session import cut_lineage, shared_root, side_by_side

ROW = ["household_id", "month_slot"]
FULL_ROUNDS, FULL_DEPTH = 300, 6
STARTER_ROUNDS, STARTER_DEPTH = 20, 4


def frame(t):
    """The training frame, computed once for the passes over it and for the models of a query."""
    if "training_frame" not in vars(t):
        t.training_frame = cut_lineage(t.household)
    return t.training_frame


def split(t, label: str):
    return tr.split_frame(frame(t), label, ROW, DEMO_CUTOFF)


def model_folder(t) -> ModelFolder:
    return ModelFolder(t.spark, f"{shared_root(t.spark)}/models")


def published(t, label: str, train, least_rounds: int):
    """The model in force for `label`, if it was trained on these rows for so many rounds."""
    return model_folder(t).load(label, fingerprint(train), least_rounds)


def fit(train, label: str, **settings):
    if label == fv.COMPOSITE_LABEL:
        return tr.train_composite_regressor(train, **settings)
    return tr.train_stress_classifier(train, label, ROW, **settings)


def fit_and_publish(t, label: str, train, rounds: int = FULL_ROUNDS, depth: int = FULL_DEPTH):
    """Fits, saves with the bounds of the training rows, puts in force and returns the loaded model."""
    full = (rounds, depth) == (FULL_ROUNDS, FULL_DEPTH)
    model = fit(train, label, **({} if full else {"rounds": rounds, "depth": depth}))
    bounds = t.spark.createDataFrame([(c, *limits) for c, limits in model.prep.bounds.items()], BOUNDS)
    return model_folder(t).publish(model, f"{rounds}x{depth}-{uuid.uuid4().hex[:12]}", fingerprint(train), rounds, depth, bounds)


def model_of(t, label: str, train):
    """The full model of `label` for these training rows, published now if it was not before."""
    return published(t, label, train, FULL_ROUNDS) or fit_and_publish(t, label, train)


def shown(df, *columns):
    return df.select("household_id", text("month_slot"), *columns)


@query("temporal_split", over(f"""
    SELECT {KEYS}, CASE WHEN month_slot < DATE '{DEMO_CUTOFF}' THEN 'train' ELSE 'test' END AS split,
           'temporal' AS split_method
    FROM household WHERE month_slot IS NOT NULL""", "household"))
def temporal_split(t):
    return shown(sm.temporal_split(t.household, "debt_stress", ROW, cutoff=DEMO_CUTOFF), "split", "split_method")


@query("stratified_random_split", over("""
    SELECT debt_stress, CASE WHEN test THEN 'test' ELSE 'train' END AS split,
           CASE WHEN test THEN cast(round(n * 0.2::DOUBLE) AS BIGINT) ELSE n - cast(round(n * 0.2::DOUBLE) AS BIGINT) END AS n
    FROM (SELECT debt_stress, count(*) AS n FROM household GROUP BY 1), (VALUES (true), (false)) AS g(test)""", "household"))
def stratified_random_split(t):
    return sm.stratified_random_split(t.household, "debt_stress", ROW).groupBy("debt_stress", "split").agg(
        F.count(F.lit(1)).alias("n"))


@query("capped_sample_per_month", over("""
    SELECT cast(month_slot AS VARCHAR) AS month_slot, least(count(*), 8000 // (SELECT count(DISTINCT month_slot) FROM household)) AS n
    FROM household GROUP BY month_slot""", "household"))
def capped_sample_per_month(t):
    return sm.capped_sample_per_month(t.household, ROW, max_rows=8000).groupBy(text("month_slot")).agg(
        F.count(F.lit(1)).alias("n"))


NUMBERS = ["exp_education", "exp_vacation", "income_all_members_from_wages", "savings_proxy"]
WORDS = ["age_group", "occupation_group", "education_group"]


@query("impute_numeric", over(f"""
    SELECT {KEYS}, {", ".join(f"round(coalesce({c}, m_{c}, 0), 6) AS {c}" for c in NUMBERS)} FROM household,
    (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUMBERS)} FROM household)""", "household"))
def impute_numeric(t):
    medians = {r.feature: r.median for r in tr.numeric_medians(t.household, NUMBERS).collect()}
    return shown(tr.impute_numeric(t.household, medians), *[rounded(c) for c in NUMBERS])


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM household WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("impute_categorical", over(f"""
    SELECT {KEYS}, {", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in WORDS)} FROM household""", "household"))
def impute_categorical(t):
    modes = t.household.agg(*[F.mode(c, True).alias(c) for c in WORDS]).first().asDict()
    return shown(tr.impute_categorical(t.household, modes), *WORDS)


@query("standardize", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM household"
    for c in NUMBERS), "household"))
def standardize(t):
    return tr.standardize_parameters(t.household, NUMBERS).select("feature", rounded("mean", 4), rounded("std", 4))


@query("ordinal_encode", over(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {c} AS level, cast(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT {c} FROM household WHERE {c} IS NOT NULL)""" for c in WORDS), "household"))
def ordinal_encode(t):
    return tr.ordinal_levels(t.household, WORDS)


def _encoded(c: str, view: str = "household") -> str:
    return f"(SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code_{c} FROM (SELECT DISTINCT {c} FROM filled))"


@query("prepare_features", over(f"""
    , filled AS (SELECT household_id, month_slot,
        {", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM household)) AS {c}" for c in NUMBERS)},
        {", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in WORDS)} FROM household)
    SELECT {KEYS}, {", ".join(f"round((filled.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUMBERS)},
           {", ".join(f"code_{c}::DOUBLE AS {c}" for c in WORDS)} FROM filled
    {" ".join(f"JOIN {_encoded(c)} USING ({c})" for c in WORDS)},
    (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)} FROM filled)""", "household"))
def prepare_features(t):
    rows = cut_lineage(t.household.select(*ROW, *NUMBERS, *WORDS))
    ready = tr.prepare(rows, tr.fit_preparation(rows, NUMBERS, WORDS))
    return shown(ready, *[
        F.round(F.element_at("x", i + 1), 6).alias(c) for i, c in enumerate([*NUMBERS, *WORDS])])


@query("nearest_neighbours", """
    SELECT query_id, round(sum(distance), 5) AS total_distance, count(*) AS n FROM (
    SELECT a.vec_id AS query_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
           lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS distance,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY distance) AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 5 GROUP BY query_id""")
def neighbours(t):
    found = nearest_neighbours(t.table("embeddings"), "vec_id", "embedding", 5, block_rows=256, query_rows=512)
    total = F.aggregate("neighbours", F.lit(0.0), lambda a, x: a + x["distance"])
    return found.select(F.col("query_id").cast("long").alias("query_id"),
                        F.round(total, 5).alias("total_distance"), F.size("neighbours").alias("n"))


@query("smote_oversample", """
    SELECT CASE WHEN label = 3 THEN 1 ELSE 0 END AS label, false AS synthetic, count(*) AS n FROM embeddings GROUP BY 1
    UNION ALL SELECT 1, true, cast(floor(count(*) FILTER (WHERE label <> 3) * 0.5) AS BIGINT) - count(*) FILTER (WHERE label = 3)
    FROM embeddings""")
def smote(t):
    rows = t.table("embeddings").withColumn("label", (F.col("label") == 3).cast("int"))
    return smote_oversample(rows, "label", "vec_id", "embedding", ratio=0.5, trigger=5.0).groupBy(
        "label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("evaluate_binary", over(f"""
    SELECT model, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
           round((tp + tn) / n, 9) AS accuracy, n AS n_test,
           round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS f1_macro FROM (
    SELECT 'debt_stress' AS model, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
           count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
           count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn
    FROM (SELECT p.y AS y, {RAW['debt_stress']} AS p FROM (
          SELECT *, CASE WHEN monthly_emi / (monthly_income + 1e-9) > 0.3 THEN 1 ELSE 0 END AS y FROM profiles) p))""", "profiles"))
def evaluate_binary(t):
    scored = with_raw(t).withColumn("debt_stress", F.coalesce(
        F.col("monthly_emi") / (F.col("monthly_income") + fv.EPS) > fv.EMI_SHARE_LIMIT, F.lit(False)).cast("int"))
    return tr.evaluate_binary(scored, "debt_stress", "debt_stress_raw").select(
        "model", *[rounded(c, 9) for c in ("precision", "recall", "accuracy", "f1_macro")], "n_test")


@query("evaluate_composite", over("""
    SELECT actual, count(*) AS support, round(sum(hit)::DOUBLE / count(*), 9) AS recall,
           (SELECT round(avg(abs(composite_stress_score - guess)), 9) FROM g) AS mae,
           (SELECT round(sqrt(avg((composite_stress_score - guess) * (composite_stress_score - guess))), 9) FROM g) AS rmse
    FROM (SELECT cast(composite_stress_score AS VARCHAR) AS actual,
                 CASE WHEN least(greatest(round_even(guess, 0), 0), 4) = composite_stress_score THEN 1 ELSE 0 END AS hit FROM g)
    GROUP BY actual""".replace("    SELECT actual", """    , g AS (SELECT composite_stress_score, food_to_expense_ratio + least(emi_to_income_ratio, 1.0) AS guess FROM household)
    SELECT actual""", 1), "household"))
def evaluate_composite(t):
    scored = t.household.withColumn("guess", F.col("food_to_expense_ratio") + F.least("emi_to_income_ratio", F.lit(1.0)))
    report = tr.evaluate_composite(scored, "guess")
    return report.filter(F.col("class").rlike("^[0-4]$") & (F.col("support") > 0)).select(
        F.col("class").alias("actual"), "support", rounded("recall", 9), rounded("mae", 9), rounded("rmse", 9))


def _f1(limit: str) -> str:
    return f"""(SELECT (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 FROM (
        SELECT count(*) FILTER (WHERE y = 1 AND p >= {limit}) AS tp, count(*) FILTER (WHERE y = 0 AND p >= {limit}) AS fp,
               count(*) FILTER (WHERE y = 1 AND p < {limit}) AS fn, count(*) FILTER (WHERE y = 0 AND p < {limit}) AS tn
        FROM (SELECT CASE WHEN monthly_emi / (monthly_income + 1e-9) > 0.3 THEN 1 ELSE 0 END AS y, {RAW['debt_stress']} AS p
              FROM profiles)))"""


@query("model_gate", over(f"""
    SELECT 'debt_stress' AS model, round(a, 9) AS current_f1, round(b, 9) AS candidate_f1, a - b <= 0.02 AS accepted
    FROM (SELECT {_f1('0.3')} AS a, {_f1('0.5')} AS b)""", "profiles"))
def model_gate(t):
    scored = with_raw(t).withColumn("debt_stress", F.coalesce(
        F.col("monthly_emi") / (F.col("monthly_income") + fv.EPS) > fv.EMI_SHARE_LIMIT, F.lit(False)).cast("int"))
    old = tr.evaluate_binary(scored, "debt_stress", "debt_stress_raw", 0.3)
    new = tr.evaluate_binary(scored, "debt_stress", "debt_stress_raw", 0.5)
    return tr.model_gate(old, new).select("model", rounded("current_f1", 9), rounded("candidate_f1", 9), "accepted")


def classifier_query(label: str):
    @query(f"train_{label}")
    def run(t):
        train, test = split(t, label)
        model = fit_and_publish(t, label, train)
        return tr.evaluate_binary(model.score(test, "probability"), label, "probability")


for stress in fv.STRESS_LABELS:
    classifier_query(stress)


@query("train_composite_regressor")
def train_composite_regressor(t):
    train, test = split(t, fv.COMPOSITE_LABEL)
    model = fit_and_publish(t, fv.COMPOSITE_LABEL, train)
    return tr.evaluate_composite(model.score(test, "composite"), "composite")


@query("feature_importance")
def feature_importance(t):
    train, _ = split(t, "financial_stress")
    model = model_of(t, "financial_stress", train)
    return tr.feature_importance(model, t.spark)


@query("top_features")
def top_features(t):
    """The ten largest importances of each of the four classifiers."""
    trains = {label: split(t, label)[0] for label in fv.STRESS_LABELS}
    models = side_by_side([partial(model_of, t, label, train) for label, train in trains.items()])
    tables = [tr.feature_importance(model, t.spark) for model in models]
    return tr.top_features(reduce(DataFrame.union, tables))


@query("model_metadata")
def model_metadata(t):
    train, _ = split(t, "debt_stress")
    model = model_of(t, "debt_stress", train)
    return tr.model_metadata([model], feature_bounds(train, model.prep.numeric), DEMO_CUTOFF, fv.MODEL_VERSION, t.spark)


@query("confidence_band")
def confidence_band(t):
    train, test = split(t, "health_stress")
    banded = tr.confidence_band(train, test, "health_stress", ROW)
    return shown(banded, "mean", "std", "confidence")


@query("batch_score")
def score_profiles(t):
    """All profiles by the models in force, loaded from the model folder; labels without one get a
    starter model first."""
    rows = frame(t)

    def starter(label: str):
        train, _ = tr.split_frame(rows, label, ROW, DEMO_CUTOFF)
        return published(t, label, train, STARTER_ROUNDS) or fit_and_publish(t, label, train, STARTER_ROUNDS, STARTER_DEPTH)

    labels = [*fv.STRESS_LABELS, fv.COMPOSITE_LABEL]
    models = dict(zip(labels, side_by_side([partial(starter, label) for label in labels])))
    composite = models.pop(fv.COMPOSITE_LABEL)
    scored = batch_score(profiles_of(rows), models, composite, explained=True)
    return shown(scored, *fv.STRESS_LABELS, fv.COMPOSITE_LABEL, "stress_level", "is_stressed",
                 F.array_join("stressed_domains", ",").alias("stressed_domains"),
                 F.array_join("input_warnings", "|").alias("input_warnings"),
                 *[F.array_join(f"{label}_drivers", "|").alias(f"{label}_drivers") for label in fv.STRESS_LABELS])


#: What the sentences on drivers name, besides the members: income, expense, food and instalments.
AMOUNTS = ["total_income", "total_expenditure_adjusted", "exp_food_adjusted", "exp_all_emis"]


@query("row_drivers")
def row_drivers(t):
    train, test = split(t, "debt_stress")
    model = model_of(t, "debt_stress", train)
    named = tr.row_drivers(model, test, ROW).join(
        test.select(*ROW, *AMOUNTS, "num_members"), ROW)
    amounts = [F.coalesce(F.col(c), F.lit(0.0)) for c in (*AMOUNTS, "num_members")]
    sentence = F.transform("drivers", lambda d: tr.driver_sentence(d["feature"], tr.driver_sentences(*amounts)))
    return shown(named, F.round("probability", 6).alias("probability"), F.array_join(sentence, "|").alias("drivers"))


@query("driver_shares", over(f"""
    SELECT {KEYS}, 3 AS n_drivers, true AS adds_up, true AS is_probability FROM household
    WHERE month_slot >= DATE '{DEMO_CUTOFF}' AND debt_stress IS NOT NULL""", "household"))
def driver_shares(t):
    """Bias and shares of all features add up to the margin that the saved ensemble itself gives."""
    train, test = split(t, "debt_stress")
    model = published(t, "debt_stress", train, STARTER_ROUNDS) or fit_and_publish(
        t, "debt_stress", train, STARTER_ROUNDS, STARTER_DEPTH)
    shares = tr.row_shares(model, test, ROW)
    own = model.score(test, "own").select(*[F.col(k).alias(f"own_{k}") for k in ROW], "own")
    both = shares.join(own, (F.col("household_id") == F.col("own_household_id")) & (F.col("month_slot") == F.col("own_month_slot")))
    total = F.aggregate("shares", F.col("bias"), lambda a, v: a + v)
    return shown(both, F.least(F.lit(3), F.size("shares")).alias("n_drivers"),
                 (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"),
                 (F.abs(F.col("probability") - F.col("own")) < 1e-9).alias("is_probability"))


EXPENSES = ["exp_food_adjusted", "exp_all_emis", "exp_health", "exp_education", "exp_recreation"]


@query("top_k_per_row", over(f"""
    SELECT {KEYS}, string_agg(feature, '|' ORDER BY r) AS top3 FROM (
    SELECT household_id, month_slot, feature, row_number() OVER (
           PARTITION BY household_id, month_slot ORDER BY abs(delta) DESC, feature) AS r
    FROM (SELECT household_id, month_slot, unnest({text_list(EXPENSES)}) AS feature,
                 unnest([{", ".join(f"coalesce({c}, 0) - total_expenditure_adjusted / 5" for c in EXPENSES)}]) AS delta
          FROM household)) WHERE r <= 3 GROUP BY household_id, month_slot""", "household"))
def top_k_per_row(t):
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), (
        F.coalesce(F.col(c), F.lit(0.0)) - F.col("total_expenditure_adjusted") / 5).alias("delta")) for c in EXPENSES])
    top = t.household.withColumn("top", tr.top_k_per_row(pairs))
    return shown(top, F.array_join(F.transform("top", lambda e: e["feature"]), "|").alias("top3"))
