"""Evaluation aggregates. Each is one pass with map-side partial sums, optionally per group;
only the exact AUC needs an order, taken from `running_totals`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.order_stats import running_totals


def class_balance(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.groupBy(*groups).agg(neg.alias("n_neg"), pos.alias("n_pos")).withColumn(
        "scale_pos_weight", F.round(F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)), 2))


def _cells(actual: str, predicted: str, classes: Sequence[int]) -> dict[tuple[int, int], Column]:
    return {(a, p): F.count_if((F.col(actual) == a) & (F.col(predicted) == p))
            for a in classes for p in classes}


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1),
                     groups: Sequence[str] = ()) -> DataFrame:
    """One row per cell of the full class grid, zero cells included."""
    cells = _cells(actual, predicted, classes)
    counted = df.groupBy(*groups).agg(*[c.alias(f"c_{a}_{p}") for (a, p), c in cells.items()])
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                              F.col(f"c_{a}_{p}").alias("n")) for a, p in cells])
    return counted.select(*groups, F.inline(rows))


def confusion_summary(df: DataFrame, actual: str, predicted: str,
                      groups: Sequence[str] = ()) -> DataFrame:
    """TN / FP / FN / TP with recall and false positive rate in percent."""
    cells = _cells(actual, predicted, (0, 1))
    counted = df.groupBy(*groups).agg(
        cells[0, 0].alias("tn"), cells[0, 1].alias("fp"), cells[1, 0].alias("fn"), cells[1, 1].alias("tp"))
    return counted.withColumns({
        "recall_pct": F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9) * 100,
        "fpr_pct": F.col("fp") / (F.col("fp") + F.col("tn") + 1e-9) * 100,
    })


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str,
                          classes: Sequence[int] = (0, 1), groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.
    Undefined ratios are 0."""
    sums: list[Column] = [F.count(F.lit(1)).alias("rows"),
                          F.count_if(F.col(actual) == F.col(predicted)).alias("right")]
    for c in classes:
        sums += [F.count_if((F.col(actual) == c) & (F.col(predicted) == c)).alias(f"tp_{c}"),
                 F.count_if(F.col(predicted) == c).alias(f"predicted_{c}"),
                 F.count_if(F.col(actual) == c).alias(f"support_{c}")]
    counted = df.groupBy(*groups).agg(*sums)
    per_class = {}
    for c in classes:
        tp, n_pred, support = F.col(f"tp_{c}"), F.col(f"predicted_{c}"), F.col(f"support_{c}")
        per_class[c] = (_ratio(tp, n_pred), _ratio(tp, support), _ratio(2 * tp, n_pred + support), support)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("long").alias("support"))

    def mean(position: int, weighted: bool) -> Column:
        total, weights = F.lit(0.0), F.lit(0.0)
        for values in per_class.values():
            weight = values[3].cast("double") if weighted else F.lit(1.0)
            total, weights = total + values[position] * weight, weights + weight
        return _ratio(total, weights)

    accuracy = _ratio(F.col("right"), F.col("rows"))
    rows = [row(str(c), *values) for c, values in per_class.items()]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, F.col("rows")))
    rows.append(row("macro avg", mean(0, False), mean(1, False), mean(2, False), F.col("rows")))
    rows.append(row("weighted avg", mean(0, True), mean(1, True), mean(2, True), F.col("rows")))
    return counted.select(*groups, F.inline(F.array(*rows)))


def auc_roc(df: DataFrame, score: str, label: str, groups: Sequence[str]) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half.

    Rows collapse to one per distinct score first; `groups` is a short list such as the
    label names, so the per-range totals are small.
    """
    by_score = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *groups, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    placed = running_totals(by_score, groups, "_score", ["pos", "neg"], few_groups=True)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5).cast("double")
    wins = F.sum(F.col("pos").cast("double") * below)
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    return placed.groupBy(*groups).agg(F.try_divide(wins, pairs).alias("auc"))


def mae_rmse(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    error = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.groupBy(*groups).agg(F.avg(F.abs(error)).alias("mae"),
                                   F.sqrt(F.avg(error * error)).alias("rmse"))


def composite_class(prediction: Column) -> Column:
    """Continuous composite to its class: rounded half to even, kept within 0-4."""
    return F.least(F.greatest(F.bround(prediction, 0), F.lit(0.0)), F.lit(4.0)).cast("int")
