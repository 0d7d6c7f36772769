"""Exact order statistics that no single task has to hold.

`percentile`, an unpartitioned window or a window over one hot group would gather a
whole column in one place. Here values are first reduced to one row per distinct value,
then cut into ranges at approximate quantiles, so that sorting and running totals happen
per range; only the per-range totals (at most `buckets` rows per group) meet in one window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

DEFAULT_BUCKETS = 64
#: Accuracy of the approximate quantiles that bracket the exact ones in `column_quantiles`.
BRACKET_ACCURACY = 2000


def running_totals(df: DataFrame, groups: Sequence[str], order_col: str, sums: Sequence[str],
                   buckets: int = DEFAULT_BUCKETS, few_groups: bool = False,
                   written: bool = False) -> DataFrame:
    """Inclusive running totals of `sums` along `order_col` within `groups`.

    `df` has one row per (groups, order_col), the column never null. Adds `cum_<s>`,
    `total_<s>` and `next_value` (the following value of the group, null at its end).
    It is written to the shared folder first: three passes read it, and however costly its
    own plan is, it runs once (`written` says the caller has done so). `few_groups` states that the number of groups is a small constant of the caller (a list
    of features or labels), which makes the range edges safe to broadcast. Without it the
    planner decides by size.
    """
    groups = list(groups)
    df = df if written else cut_lineage(df)
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.groupBy(*groups).agg(
        F.percentile_approx(order_col, cuts, F.lit(10000)).alias("_edges"),
        *[F.sum(s).alias(f"total_{s}") for s in sums],
    )
    small = F.broadcast if few_groups else (lambda side: side)
    placed = df.join(small(edges), groups).withColumn(
        "_range", F.size(F.filter("_edges", lambda edge: edge < F.col(order_col)))).drop("_edges")
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy(*groups).orderBy("_range")
    offsets = (
        placed.groupBy(*groups, "_range")
        .agg(F.min(order_col).alias("_first"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
        .select(
            *groups, "_range",
            F.lead("_first").over(following).alias("_next_first"),
            *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        )
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(order_col)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(small(offsets), groups + ["_range"]).select(
        *df.columns,
        *[f"total_{s}" for s in sums],
        *[(F.col(f"_before_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums],
        F.coalesce(F.lead(order_col).over(inside), F.col("_next_first")).alias("next_value"),
    )


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float],
              buckets: int = DEFAULT_BUCKETS, few_groups: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    `probabilities` maps output column to probability. Nulls and NaN take no part; a group
    without values has no row.
    """
    groups = list(groups)
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*groups, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counts, groups, "_value", ["n"], buckets, few_groups)
    picks, finals = quantile_columns(probabilities, "_value", "n")
    return placed.groupBy(*groups).agg(*picks).select(*groups, *finals)


def quantile_columns(probabilities: dict[str, float], value: str, count: str) -> tuple[list[Column], list[Column]]:
    """Aggregates over a `running_totals` result, and the quantiles computed from them."""
    n, upto, total = F.col(count), F.col(f"cum_{count}"), F.col(f"total_{count}")
    picks, finals = [F.max(total).alias("_total")], []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (total - 1)
        for part, position in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (position >= upto - n) & (position < upto)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{part}_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = F.lit(float(p)) * (F.col("_total") - 1)
        finals.append((lo + (hi - lo) * (share - F.floor(share))).alias(name))
    return picks, finals


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns as (feature, value) rows of double, NaN as null."""
    number = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    return df.select(*keep, *number).unpivot(list(keep), list(columns), name, value)


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles of many columns, those of `quantiles` over their long form: `feature` and one
    column per probability, no row for a column without values.

    The columns are written once. Approximate quantiles bracket each exact one, rows below and up to
    the bracket are counted, and only values inside it (well below a hundredth of the rows where they
    differ) are made long, grouped and ranked; a bracket of one value needs no more. A column with a
    bracket that misses its rank, such as one of few values, goes through `quantiles`.
    """
    columns, spark = list(columns), df.sparkSession
    schema = ", ".join(["feature string", *[f"{name} double" for name in probabilities]])
    if not columns:
        return spark.createDataFrame([], schema)
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)}
    own = cut_lineage(df.select(*number.values()))
    names = dict(zip(columns, own.columns))
    margin = 2 / BRACKET_ACCURACY + 2 / max(own.count(), 1)
    cuts = F.array(*[F.lit(min(max(p + side, 0.0), 1.0)) for p in probabilities.values() for side in (-margin, margin)])
    edges = own.agg(*[F.percentile_approx(c, cuts, F.lit(BRACKET_ACCURACY)).alias(c) for c in own.columns]).first()
    brackets = {(c, name): tuple(edges[names[c]][2 * i:2 * i + 2]) for c in columns if edges[names[c]]
                for i, name in enumerate(probabilities)}
    counts = own.agg(*[F.count(names[c]).alias(f"n_{names[c]}") for c in columns],
                     *[F.count_if(F.col(names[c]) < F.lit(low)).alias(f"below_{names[c]}_{name}") for (c, name), (low, _) in brackets.items()],
                     *[F.count_if(F.col(names[c]) <= F.lit(high)).alias(f"upto_{names[c]}_{name}")
                       for (c, name), (_, high) in brackets.items()]).first()
    missed, known, open_ranks = set(), {}, {}
    for (c, name), (low, high) in brackets.items():
        rank = probabilities[name] * (counts[f"n_{names[c]}"] - 1)
        below, upto = counts[f"below_{names[c]}_{name}"], counts[f"upto_{names[c]}_{name}"]
        if not below <= math.floor(rank) <= math.ceil(rank) < upto:
            missed.add(c)
        elif low == high:
            known[c, name] = low + (high - low) * (rank - math.floor(rank)) + 0.0  # no negative zero, as in a grouped value
        else:
            open_ranks[c, name] = (low, high, below, math.floor(rank), math.ceil(rank), rank - math.floor(rank))
    if open_ranks:
        inside = F.array(*[F.when(F.col(names[c]).between(low, high), F.struct(
            F.lit(c).alias("feature"), F.lit(name).alias("part"), F.col(names[c]).alias("_value")))
            for (c, name), (low, high, *_) in open_ranks.items()])
        found = own.select(F.explode(inside).alias("v")).filter("v is not null").select("v.*").groupBy(
            "feature", "part", "_value").agg(F.count(F.lit(1)).alias("n"))
        ranked = running_totals(found, ["feature", "part"], "_value", ["n"], few_groups=True)
        asked = spark.createDataFrame([(c, name, *rest) for (c, name), (_, _, *rest) in open_ranks.items()],
                                      "feature string, part string, below long, lo long, hi long, share double")
        upto = F.col("below") + F.col("cum_n")
        picked = ranked.join(F.broadcast(asked), ["feature", "part"]).groupBy("feature", "part", "share").agg(
            *[F.max(F.when((F.col(r) >= upto - F.col("n")) & (F.col(r) < upto), F.col("_value"))).alias(f"_{r}") for r in ("lo", "hi")])
        for r in picked.withColumn("q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("share")).collect():
            known[r.feature, r.part] = r.q
    done = [c for c in columns if c not in missed and (c, next(iter(probabilities))) in brackets]
    exact = spark.createDataFrame([(c, *[known[c, name] for name in probabilities]) for c in done], schema)
    if not missed:
        return exact
    rest = own.select(*[F.col(names[c]).alias(c) for c in columns if c in missed])
    return exact.union(quantiles(long_form(rest, rest.columns), ["feature"], "value", probabilities, few_groups=True)
                       .select("feature", *probabilities))
