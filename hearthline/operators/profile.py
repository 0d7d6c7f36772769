"""Data-quality profiles and label summaries: one aggregate pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import fixed_values as fv
from hearthline.operators.order_stats import column_quantiles, long_form, quantiles

#: The quantiles between which inputs of a model are expected.
BOUNDS = {"p1": 0.01, "p99": 0.99}


def _rows(structs: Sequence[Column]) -> Column:
    return F.inline(F.array(*structs))


def label_prevalence(df: DataFrame, labels: Sequence[str] = tuple(fv.STRESS_LABELS),
                     groups: Sequence[str] = (), composite: str | None = fv.COMPOSITE_LABEL) -> DataFrame:
    """Positives, non-null rows and positive share per label; the mean for the composite."""
    names = [*labels, *([composite] if composite else [])]
    counted = df.groupBy(*groups).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}") for c in names],
        *[F.count(c).alias(f"n_{c}") for c in names])
    return counted.select(*groups, _rows([
        F.struct(F.lit(c).alias("label"), F.col(f"s_{c}").cast("long").alias("positives"),
                 F.col(f"n_{c}").alias("n_rows"),
                 F.try_divide(F.col(f"s_{c}").cast("double"), F.col(f"n_{c}")).alias("mean"))
        for c in names]))


def prevalence_rollup(df: DataFrame, groups: Sequence[str], labels: Sequence[str] = tuple(fv.STRESS_LABELS)) -> DataFrame:
    """Prevalence per label at every level of `groups`, from one pass: the whole table, the first
    group, the first two and so on. `depth` says how many groups a row stands for; those beyond are null."""
    counted = df.rollup(*groups).agg(
        (F.lit(len(groups)) - sum((F.grouping(g).cast("int") for g in groups), F.lit(0))).alias("depth"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}") for c in labels], *[F.count(c).alias(f"n_{c}") for c in labels])
    return counted.select("depth", *groups, _rows([
        F.struct(F.lit(c).alias("label"), F.col(f"s_{c}").cast("long").alias("positives"), F.col(f"n_{c}").alias("n_rows"),
                 F.try_divide(F.col(f"s_{c}").cast("double"), F.col(f"n_{c}")).alias("mean")) for c in labels]))


def composite_distribution(df: DataFrame, column: str = fv.COMPOSITE_LABEL,
                           rare_share: float = 0.01) -> DataFrame:
    """Rows and share per composite score, with a flag for rare classes.

    The shares divide at most five counts by their own total.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("score")).agg(
        F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # of at most five rows
    return counts.select("score", "n", share.alias("share"), (share < rare_share).alias("is_rare"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, limit_pct: float = 30.0) -> DataFrame:
    """Missing rows and percent per column, flagged above the limit. NaN counts as missing."""
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def missing(c: str) -> Column:
        null = F.col(c).isNull()
        return null | F.isnan(c) if isinstance(types[c], (T.DoubleType, T.FloatType)) else null

    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(c)).alias(f"m_{c}") for c in names])
    return counted.select("n", _rows([
        F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing")) for c in names])
    ).select(
        "column_name", "missing",
        F.coalesce(F.try_divide(F.col("missing") * F.lit(100.0).cast("double"), F.col("n")),
                   F.lit(0.0)).alias("missing_pct"),
    ).withColumn("flagged", F.col("missing_pct") > limit_pct)


def overall_missing(df: DataFrame) -> DataFrame:
    """Missing cells over all cells."""
    profile = null_profile(df)
    return profile.agg(F.sum("missing").alias("missing_cells"), F.avg("missing_pct").alias("missing_pct"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def sentinel_leftover(df: DataFrame, sentinel: float = fv.MONEY_SENTINEL) -> DataFrame:
    """Cells of numeric columns that still hold the sentinel, per column."""
    names = numeric_columns(df)
    counted = df.agg(*[F.count_if(F.col(c) == sentinel).alias(f"s_{c}") for c in names])
    return counted.select(_rows([
        F.struct(F.lit(c).alias("column_name"), F.col(f"s_{c}").alias("left_over")) for c in names]))


def ratio_describe(df: DataFrame, columns: Sequence[str] = tuple(fv.RATIO_COLUMNS)) -> DataFrame:
    """Mean, sample deviation, exact median, minimum and maximum per column, nulls out."""
    long = long_form(df, columns).filter(F.col("value").isNotNull())
    summary = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    medians = quantiles(long, ["feature"], "value", {"median": 0.5}, few_groups=True)
    return summary.join(medians, "feature")


def date_range_states(df: DataFrame, month: str = "month_slot", state: str = "state") -> DataFrame:
    return df.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"),
                  F.countDistinct(state).alias("states"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_states(df: DataFrame, k: int = 5, column: str = "state") -> DataFrame:
    """The k most frequent values; equal counts by name."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null levels per categorical column, one row per level."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "level")
    return long.filter(F.col("level").isNotNull()).distinct()


def feature_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact p1 and p99 per numeric feature."""
    return column_quantiles(df, features, BOUNDS)


#: How text that is a negative number begins. Other text is not parsed, as each failure costs an exception.
NEGATIVE = r"^[\x00-\x20]*-"


def profile_row(df: DataFrame, dataset: str, sentinel: float = fv.MONEY_SENTINEL) -> DataFrame:
    """Rows, columns, missing cells and sentinel cells of one table, as text or number."""
    def is_sentinel(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            parsed = F.trim(column).try_cast("double") == sentinel
            return F.when(F.contains(column, F.lit("-")) & column.rlike(NEGATIVE), parsed) if sentinel < 0 else parsed
        return column == sentinel if isinstance(field.dataType, T.NumericType) else F.lit(False)

    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    sentinels = reduce(lambda a, b: a + b, [F.count_if(is_sentinel(f)) for f in df.schema.fields])
    return df.agg(F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"), missing.alias("missing_cells"),
                  sentinels.alias("sentinel_cells"))


def raw_vs_clean_diff(raw: DataFrame, clean: DataFrame, dataset: str, sentinel: float = fv.MONEY_SENTINEL) -> DataFrame:
    """What cleaning changed: rows, columns, missing share and sentinels. One scan a table."""
    before = profile_row(raw, dataset, sentinel).alias("b")
    after = profile_row(clean, dataset, sentinel).alias("a")

    def pct(side: str) -> Column:
        return F.coalesce(F.try_divide(
            F.col(f"{side}.missing_cells") * F.lit(100.0).cast("double"),
            F.col(f"{side}.n_rows") * F.col(f"{side}.n_columns")), F.lit(0.0))

    return before.join(after, "dataset").select(
        "dataset",
        F.col("b.n_rows").alias("raw_rows"), F.col("a.n_rows").alias("clean_rows"),
        (F.col("a.n_rows") - F.col("b.n_rows")).alias("row_delta"),
        (F.col("a.n_columns") - F.col("b.n_columns")).alias("column_delta"),
        (pct("a") - pct("b")).alias("missing_pct_delta"),
        (F.col("b.sentinel_cells") - F.col("a.sentinel_cells")).alias("sentinels_removed"),
    )


def quality_scorecard(checks: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Named data checks: each an aggregate condition over a table, true or false.

    All checks of one table (the same DataFrame) are aggregates of one scan.
    """
    tables: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, condition) in checks.items():
        tables.setdefault(id(df), (df, []))[1].append((name, condition))
    parts = []
    for df, own in tables.values():
        found = df.agg(*[F.coalesce(condition, F.lit(False)).alias(f"c{i}") for i, (_, condition) in enumerate(own)])
        parts.append(found.select(_rows([
            F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("passed")) for i, (name, _) in enumerate(own)])))
    return reduce(DataFrame.union, parts)


def scorecard_total(scorecard: DataFrame) -> DataFrame:
    return scorecard.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
