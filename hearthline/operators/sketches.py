"""Quantile sketches per month and column, kept and merged: drift without reading old months again.

A month is sketched once, all its columns in one pass over its rows; tasks send sketches of a few
kilobytes and no rows. Any baseline or window is then a merge of stored sketches. A quantile
from a sketch has, with 99 % confidence, a rank within RANK_ERROR of the one asked for, merged
or not; exact figures come from `order_stats`. Null and NaN values are left out, and a column without
values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of the sketches and the rank error that goes with it (2.296 / K^0.9723).
K, RANK_ERROR = 1000, 0.0028
#: Quantiles of each side by which two distributions are compared.
GRID = 500
PSI_FLOOR = 0.0001
SKETCHES = "feature string, n long, sketch binary"


def month_sketches(df: DataFrame, columns: Sequence[str], month: str = "month_slot") -> DataFrame:
    """month, feature, n and sketch: one scan and one row a month before it is laid out."""
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    made = [F.struct(F.lit(c).alias("feature"), F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(K)).alias("sketch"))
            for c, v in values.items()]
    whole = df.groupBy(F.col(month).cast("string").alias("month")).agg(*[s.alias(f"s{i}") for i, s in enumerate(made)])
    entries = F.explode(F.array(*[f"s{i}" for i in range(len(made))]))
    return whole.select("month", entries.alias("s")).select("month", "s.*").filter("n > 0")


class SketchStore:
    """Sketches of the months seen so far, one folder a month."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, columns: Sequence[str], month: str = "month_slot") -> None:
        """Sketches the months in `df`, replacing what was kept of them. Rows without a month are left out."""
        (month_sketches(df.filter(F.col(month).isNotNull()), columns, month).repartition("month").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path))

    def months(self) -> DataFrame:
        try:
            stored = self.spark.read.schema(f"{SKETCHES}, month string").parquet(self.path)
        except AnalysisException:
            stored = self.spark.createDataFrame([], f"{SKETCHES}, month string")
        return stored

    def merged(self, of: Column | None = None) -> DataFrame:
        """feature, n and sketch over the stored months for which `of` (on `month`) holds."""
        rows = self.months() if of is None else self.months().filter(of)
        return rows.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(merged: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """feature, n and one column per probability."""
    return merged.select("feature", "n", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in probabilities.items()])


def sketch_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """KS distance and PSI over baseline deciles per feature, from two merged sides.

    Each side is taken as its GRID quantiles, so the KS distance lies within 2 RANK_ERROR + 2 / GRID
    of the exact one. Features that one side lacks have no row.
    """
    sides = baseline.select("feature", F.col("n").alias("n_base"), F.col("sketch").alias("b")).join(
        current.select("feature", F.col("n").alias("n_cur"), F.col("sketch").alias("c")), "feature")
    ranks = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    tenths = F.array(*[F.lit(i / 10) for i in range(1, 10)])
    placed = sides.select("feature", "n_base", "n_cur", F.kll_sketch_get_quantile_double("b", ranks).alias("b"),
                          F.kll_sketch_get_quantile_double("c", ranks).alias("c"),
                          F.array_distinct(F.kll_sketch_get_quantile_double("b", tenths)).alias("deciles"))

    def share(side: str, x: Column) -> Column:
        """The share of a side's values up to `x`."""
        return F.size(F.filter(side, lambda v: v <= x)) / F.lit(float(GRID))

    def shares(side: str) -> Column:
        """Shares below, between and above the deciles, none below the floor."""
        edges = F.concat(F.array(F.lit(0.0)), F.transform("deciles", lambda e: share(side, e)), F.array(F.lit(1.0)))
        steps = F.zip_with(F.slice(edges, F.lit(2), F.size(edges) - 1), F.slice(edges, F.lit(1), F.size(edges) - 1), lambda b, a: b - a)
        return F.transform(steps, lambda s: F.greatest(s, F.lit(PSI_FLOOR)))

    gaps = F.transform(F.array_distinct(F.concat("b", "c")), lambda x: F.abs(share("b", x) - share("c", x)))
    terms = F.zip_with(shares("b"), shares("c"), lambda p, q: (q - p) * F.ln(q / p))
    return placed.select("feature", "n_base", "n_cur", F.array_max(gaps).alias("ks"),
                         F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))
