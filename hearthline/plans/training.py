"""Training-set preparation, boosted trees, evaluation and row explanations.

What the driver holds are fitted values of fixed size: one median, mean and deviation per
numeric feature, the level list per categorical feature, trees and metric rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.functions.features import recency_weight
from hearthline.functions.labels import share
from hearthline.functions.scoring import confidence_of
from hearthline.operators.cleaning import drop_null_label, model_features
from hearthline.operators.metrics import auc_roc, classification_report, composite_class, mae_rmse
from hearthline.operators.neighbours import smote_oversample
from hearthline.operators.order_stats import column_quantiles, long_form
from hearthline.operators.profile import BOUNDS, category_levels
from hearthline.operators.sampling import poisson_one, temporal_split, uniform
from hearthline.plans.trees import FlatTrees, explain, read_trees
from hearthline.session import cut_lineage, shared_dir, side_by_side

#: Levels up to which a column's list is also held by the driver, in `Preparation.levels`; no result uses that copy.
MAX_MAPPED_LEVELS = 2000
#: Rows of a fit that a partition holds at most, and rows a core from which on a fit's rows are dealt evenly.
PART_ROWS, EVEN_FROM = 500_000, 10_000
SCRATCH = ["_x", "_features", "_prediction", "_probability", "_margin"]


@dataclass
class Preparation:
    """Fitted preparation: medians and scales for numbers, modes and levels for categories."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    level_tables: dict[str, DataFrame] = field(default_factory=dict)
    typical_codes: dict[str, int] = field(default_factory=dict)
    #: p1 and p99 of the numbers of the rows it was fitted on
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def neutral(self, name: str) -> float:
        """The prepared value of a feature's median or most frequent level."""
        if name in self.numeric:
            return (self.medians[name] - self.means[name]) / self.scales[name]
        return float(self.typical_codes.get(name, -1))


def impute_numeric(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m))
                           for c, m in medians.items()})


def impute_categorical(df: DataFrame, modes: dict[str, str | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items() if m is not None})


def numeric_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column; a column without values gets 0."""
    found = column_quantiles(df, columns, {"median": 0.5})
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))


def standardize_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, a zero deviation replaced by 1."""
    return long_form(df, columns).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn(
        "std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def ordinal_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted level -> code 0..n-1 per column, from the distinct levels only."""
    order = Window.partitionBy("feature").orderBy("level")
    return category_levels(df, columns).withColumn("code", F.row_number().over(order) - 1)


def fit_preparation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preparation:
    prep = Preparation([c for c in numeric if c in df.columns], [c for c in categorical if c in df.columns])
    found = {r.feature: r for r in column_quantiles(df, prep.numeric, {"median": 0.5, **BOUNDS}).collect()}
    prep.medians = {c: found[c].median if c in found else 0.0 for c in prep.numeric}
    prep.bounds = {c: tuple(found[c][name] for name in BOUNDS) for c in prep.numeric if c in found}
    filled = impute_numeric(df, prep.medians)
    stats = filled.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in prep.numeric],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in prep.numeric],
        *[F.mode(c, True).alias(f"mode_{c}") for c in prep.categorical]).first().asDict()
    prep.means = {c: stats[f"mean_{c}"] or 0.0 for c in prep.numeric}
    prep.scales = {c: stats[f"std_{c}"] or 1.0 for c in prep.numeric}
    prep.modes = {c: stats[f"mode_{c}"] for c in prep.categorical}
    if prep.categorical:
        _fit_levels(df, prep)
    return prep


def _fit_levels(df: DataFrame, prep: Preparation) -> None:
    """One written table of all levels; codes and the code of the most frequent level come from it."""
    table = cut_lineage(ordinal_levels(df, prep.categorical).select("feature", "level", "code"))
    prep.level_tables = {c: table.filter(F.col("feature") == c).select(F.col("level").alias(c), "code")
                         for c in prep.categorical}
    modes = df.sparkSession.createDataFrame(list(prep.modes.items()), "feature string, level string")
    prep.typical_codes = {r.feature: r.code for r in table.join(modes, ["feature", "level"]).collect()}
    short = table.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") <= MAX_MAPPED_LEVELS).drop("n")
    for r in table.join(short, "feature", "left_semi").orderBy("feature", "code").collect():
        prep.levels.setdefault(r.feature, []).append(r.level)


def prepare(df: DataFrame, prep: Preparation, output: str = "x") -> DataFrame:
    """Adds the prepared feature array. Level tables of every size are joined, the planner
    choosing how."""
    df = impute_categorical(df, prep.modes)
    for c in prep.categorical:
        df = df.join(prep.level_tables[c].toDF(f"_level_{c}", f"_code_{c}"), F.col(c) == F.col(f"_level_{c}"), "left")
    codes = [F.coalesce(F.col(f"_code_{c}").cast("double"), F.lit(-1.0)) for c in prep.categorical]
    numbers = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(prep.medians[c]))
                - F.lit(prep.means[c])) / F.lit(prep.scales[c]) for c in prep.numeric]
    out = df.withColumn(output, F.array(*numbers, *codes))
    return out.drop(*[f"_{kind}_{c}" for c in prep.categorical for kind in ("level", "code")])


@dataclass
class StressModel:
    """One fitted model with its own feature list."""

    label: str
    prep: Preparation
    model: GBTClassificationModel | GBTRegressionModel
    scale_pos_weight: float | None = None
    #: folder of the saved trees, and the p1 and p99 of inputs, of a model that was loaded
    trees_path: str | None = None
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def flat(self, spark: SparkSession) -> FlatTrees:
        """The trees as arrays, read from where they are saved."""
        if self.trees_path is None:
            self.trees_path = shared_dir(spark, "trees")
            self.model.write().save(self.trees_path)
        return read_trees(spark, self.trees_path)

    def score(self, df: DataFrame, output: str) -> DataFrame:
        vector = prepare(df, self.prep, "_x").withColumn("_features", array_to_vector("_x"))
        if isinstance(self.model, GBTRegressionModel):
            return self.model.transform(vector).withColumn(output, F.col("_prediction")).drop(*SCRATCH)
        return (self.model.transform(vector)
                .withColumn(output, vector_to_array("_probability")[1]).drop(*SCRATCH))


def dealt_evenly(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a fit in equal partitions, one a core or a multiple of that.

    Every level of every tree is a job that waits for its longest task, and files as the planner packs
    them are partitions of very different sizes. Small tables, whose levels are all overhead, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if rows < cores * EVEN_FROM else df.repartition(cores * math.ceil(rows / (cores * PART_ROWS)))


def _settings(rounds: int, depth: int) -> dict:
    return dict(featuresCol="_features", labelCol="label", weightCol="weight", predictionCol="_prediction",
                maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8,
                featureSubsetStrategy="0.8", seed=42)


def _classifier(rounds: int, depth: int) -> GBTClassifier:
    trees = GBTClassifier(**_settings(rounds, depth))
    return trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")


def _with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def train_stress_classifier(train: DataFrame, label: str, keys: Sequence[str], rounds: int = 300,
                            depth: int = 6, row_weight: Column | None = None) -> StressModel:
    """Boosted trees for one label, weighted by class balance and recency.

    Rare positives are oversampled on the prepared vectors; oversampled sets have no recency
    weights. `row_weight`, such as a bootstrap count, holds in either case, and synthetic rows take
    that of the row they were made from.
    """
    train = drop_null_label(train, label)
    prep = fit_preparation(train, model_features(label, fv.NUMERIC_FEATURES), fv.CATEGORICAL_FEATURES)
    recency = recency_weight(F.col("month_slot")) if "month_slot" in train.columns else F.lit(1.0)
    ready = cut_lineage(_with_key(prepare(train, prep), keys).select(
        "_key", "x", F.col(label).cast("int").alias("label"),
        recency.alias("recency"), (row_weight if row_weight is not None else F.lit(1.0)).cast("double").alias("row_weight")))
    sizes = ready.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    scale = round(sizes.neg / max(sizes.pos, 1), 2)
    class_weight = F.when(F.col("label") == 1, F.lit(float(scale) or 1.0)).otherwise(F.lit(1.0))
    if sizes.pos > 1 and scale > fv.SMOTE_TRIGGER_RATIO:
        ready = smote_oversample(ready, "label", "_key", "x", carry=["row_weight"])
        weighted = ready.withColumn("weight", class_weight * F.col("row_weight"))
    else:
        weighted = ready.withColumn("weight", class_weight * F.col("recency") * F.col("row_weight"))
    fit_on = weighted.select(array_to_vector("x").alias("_features"), F.col("label").cast("double").alias("label"), "weight")
    return StressModel(label, prep, _classifier(rounds, depth).fit(dealt_evenly(fit_on, sizes.neg + sizes.pos)), scale)


def train_composite_regressor(train: DataFrame, label: str = fv.COMPOSITE_LABEL, rounds: int = 300,
                              depth: int = 6) -> StressModel:
    train = drop_null_label(train, label)
    prep = fit_preparation(train, fv.NUMERIC_FEATURES, fv.CATEGORICAL_FEATURES)
    recency = recency_weight(F.col("month_slot")) if "month_slot" in train.columns else F.lit(1.0)
    ready = cut_lineage(prepare(train, prep).select(
        array_to_vector("x").alias("_features"), F.col(label).cast("double").alias("label"),
        recency.alias("weight")))
    return StressModel(label, prep, GBTRegressor(**_settings(rounds, depth)).fit(dealt_evenly(ready, ready.count())))


def evaluate_binary(scored: DataFrame, label: str, probability: str, threshold: float | None = None) -> DataFrame:
    """One row of test metrics for one label."""
    limit = fv.EVALUATION_THRESHOLDS[label] if threshold is None else threshold
    judged = scored.select(F.lit(label).alias("model"), F.col(label).cast("int").alias("actual"),
                           F.col(probability).alias("probability"),
                           (F.col(probability) >= limit).cast("int").alias("predicted"))
    report = classification_report(judged, "actual", "predicted", groups=["model"])
    wide = report.groupBy("model").agg(
        F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("f1_macro"),
        F.max(F.when(F.col("class") == "1", F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("class") == "1", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "accuracy", F.col("support"))).alias("n_test"))
    auc = auc_roc(judged, "probability", "actual", ["model"])
    return wide.join(auc, "model", "left").withColumn("threshold", F.lit(limit))


def evaluate_composite(scored: DataFrame, prediction: str, label: str = fv.COMPOSITE_LABEL) -> DataFrame:
    """Five-class report of the rounded prediction, with the regression errors on each row."""
    judged = scored.select(F.lit("composite").alias("model"), F.col(label).cast("int").alias("actual"),
                           F.col(prediction).alias("prediction"),
                           composite_class(F.col(prediction)).alias("predicted"))
    errors = mae_rmse(judged, "actual", "prediction", ["model"])
    return classification_report(judged, "actual", "predicted", range(5), ["model"]).join(
        F.broadcast(errors), "model")


def feature_importance(model: StressModel, spark) -> DataFrame:
    """Importance per feature, named from the model's own feature list."""
    values = model.model.featureImportances.toArray()
    return spark.createDataFrame(
        [(model.label, n, float(v)) for n, v in zip(model.prep.features, values)],
        "model string, feature string, importance double")


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def model_metadata(models: Sequence[StressModel], bounds: DataFrame, cutoff: str, version: str, spark) -> DataFrame:
    """One row per model: features, levels, exclusions, threshold, cutoff and input bounds."""
    limits = {r.feature: {"p1": r.p1, "p99": r.p99} for r in bounds.collect()}
    rows, levels = [], spark.createDataFrame([], "model string, feature string, level string, code int")
    for m in models:
        rows.append((m.label, m.prep.features, fv.EXCLUDED_FEATURES.get(m.label, []),
                     fv.EVALUATION_THRESHOLDS.get(m.label), m.scale_pos_weight, cutoff, version,
                     json.dumps({f: limits[f] for f in m.prep.numeric if f in limits})))
        for c, table in m.prep.level_tables.items():
            levels = levels.union(table.select(F.lit(m.label), F.lit(c), F.col(c), F.col("code").cast("int")))
    lists = levels.groupBy("model", "feature").agg(F.sort_array(F.collect_list(F.struct("code", "level"))).alias("l"))
    texts = lists.groupBy("model").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("feature", F.transform("l", lambda e: e["level"])))))).alias("levels"))
    fixed = spark.createDataFrame(
        rows, "model string, features array<string>, excluded array<string>, threshold double, "
              "scale_pos_weight double, train_cutoff string, model_version string, feature_percentiles string")
    return fixed.join(texts, "model", "left").select(
        "model", "features", "excluded", F.coalesce("levels", F.lit("{}")).alias("levels"), "threshold",
        "scale_pos_weight", "train_cutoff", "model_version", "feature_percentiles")


def confidence_band(train: DataFrame, rows: DataFrame, label: str, keys: Sequence[str], bags: int = 8,
                    rounds: int = 20, depth: int = 4) -> DataFrame:
    """Mean and deviation of the probability over models fitted on Poisson bootstrap weights."""
    def fit(b: int) -> StressModel:
        weight = poisson_one(uniform(keys, 1000 + b))
        return train_stress_classifier(train.filter(weight > 0), label, keys, rounds, depth, weight)

    scored = rows
    for b, model in enumerate(side_by_side([partial(fit, b) for b in range(bags)])):
        scored = model.score(scored, f"_p{b}")
    bag = F.array(*[f"_p{b}" for b in range(bags)])
    mean = F.aggregate(bag, F.lit(0.0), lambda a, x: a + x) / bags
    scored = scored.withColumn("mean", mean)
    spread = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / bags)
    return scored.withColumn("std", spread).withColumn("confidence", confidence_of(F.col("std"))).drop(
        *[f"_p{b}" for b in range(bags)])


def top_k_per_row(pairs: Column, k: int = 3) -> Column:
    """The k entries (feature, delta) with the largest absolute delta, name breaking ties."""
    ranked = F.array_sort(F.transform(pairs, lambda e: F.struct(
        (-F.abs(e["delta"])).alias("order"), e["feature"].alias("feature"), e["delta"].alias("delta"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["feature"], e["delta"]))


def row_shares(model: StressModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, probability, margin, bias and the share of every feature of the model in the margin."""
    ready = prepare(rows, model.prep, "_x").select(*keys, "_x")
    return explain(ready, model.flat(rows.sparkSession), "_x")


def row_drivers(model: StressModel, rows: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k features with the largest shares in a row's margin, either way, along the trees' paths."""
    names = F.array(*map(F.lit, model.prep.features))
    shares = F.transform("shares", lambda v, i: F.struct(F.get(names, i).alias("feature"), v.alias("delta")))
    return row_shares(model, rows, keys).select(*keys, "probability", top_k_per_row(shares, k).alias("drivers"))


def driver_sentences(income: Column, expense: Column, food: Column, emi: Column, members: Column | None = None) -> dict[str, Column]:
    """What is said of a driver, per feature; null where the sentence needs an answer that is missing."""
    def money(amount: Column) -> Column:
        return F.format_string("₹%,.0f", F.bround(amount, 0))

    def of(part: Column, whole: Column) -> Column:
        return F.format_string("%.0f%%", F.bround(share(part, whole) * 100, 0))

    sentences = {
        "food_to_expense_ratio": F.concat(F.lit("Food expense is "), of(food, expense), F.lit(" of total spending")),
        "savings_proxy": F.concat(F.lit("Monthly savings buffer is "), money(income - expense)),
        "emi_to_income_ratio": F.concat(F.lit("EMI is "), of(emi, income), F.lit(" of income")),
        "health_to_expense_ratio": F.lit("Health spend is high relative to budget"),
        "income_all_members_from_wages": F.concat(F.lit("Wage income: "), money(income), F.lit("/month")),
    }
    if members is not None:
        sentences["age_years_hh_mean"] = F.when((members > 0) & (income > 0), F.concat(
            F.lit("Family of "), members.cast("int").cast("string"), F.lit(" on "), money(income), F.lit("/month")))
    return sentences


def driver_sentence(feature: Column, profile_sentences: dict[str, Column]) -> Column:
    """Readable text for a driver; features without a sentence are named in words."""
    words = F.concat(F.initcap(F.replace(feature, F.lit("_"), F.lit(" "))), F.lit(" is a key driver"))
    said = [F.when(feature == name, sentence) for name, sentence in profile_sentences.items()]
    return F.coalesce(*said, words)


def model_gate(current: DataFrame, candidate: DataFrame, max_drop: float = 0.02) -> DataFrame:
    """Accept a retrained model unless its macro F1 drops by more than `max_drop`."""
    old = current.select("model", F.col("f1_macro").alias("current_f1"))
    new = candidate.select("model", F.col("f1_macro").alias("candidate_f1"))
    return old.join(new, "model").withColumn(
        "accepted", F.col("current_f1") - F.col("candidate_f1") <= max_drop)


def split_frame(df: DataFrame, label: str, keys: Sequence[str], cutoff: str) -> tuple[DataFrame, DataFrame]:
    both = temporal_split(drop_null_label(df, label), label, keys, cutoff=cutoff)
    both = both.drop("split_method")
    return both.filter(F.col("split") == "train"), both.filter(F.col("split") == "test")
