"""Deterministic samples and splits driven by a hash of the row's key.

Ranks are exact, yet no month or class is ever sorted in one task: the hash space is cut
into equal ranges first, which stay even however large one group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import fixed_values as fv

HASH_BITS = 10


def row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def hash_rank(df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds `hash_rank` (1-based, exact, by hash order) and `group_rows` within `groups`.

    Rows are ranked inside one of 1024 hash ranges of their group; the ranges' counts, a
    table of groups x 1024 rows, give the offset.
    """
    groups = list(groups)
    hashed = df.withColumn("_hash", row_hash(keys, seed)).withColumn(
        "_range", F.shiftright(F.col("_hash"), 64 - HASH_BITS))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = hashed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *groups, "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"))
    inside = Window.partitionBy(*groups, "_range").orderBy("_hash", *keys)
    match = [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*groups, "_range"]]
    placed = hashed.alias("h").join(offsets.alias("o"), reduce(lambda a, b: a & b, match))
    return placed.select("h.*", "o._before", "o.group_rows").withColumn(
        "hash_rank", F.col("_before") + F.row_number().over(inside)
    ).drop("_hash", "_range", "_before")


def capped_sample_per_month(df: DataFrame, keys: Sequence[str], max_rows: int = fv.MAX_TRAINING_ROWS,
                            group: str = "month_slot", seed: int = 42,
                            months: int | None = None, salts: int = 64) -> DataFrame:
    """At most max_rows / months rows of every month, the lowest hashes of each.

    The cap is this operator's purpose. Each salt keeps its own lowest `cap` rows first, so
    the final ranking of a month sees at most salts x cap rows.
    """
    if months is None:
        months = df.select(group).distinct().count()
    cap = max(1, max_rows // max(months, 1))
    hashed = df.withColumn("_hash", row_hash(keys, seed)).withColumn(
        "_salt", F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(salts)))
    first = Window.partitionBy(group, "_salt").orderBy("_hash", *keys)
    final = Window.partitionBy(group).orderBy("_hash", *keys)
    kept = hashed.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= cap)
    return (kept.withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= cap)
            .drop("_hash", "_salt", "_rank"))


def stratified_random_split(df: DataFrame, label: str, keys: Sequence[str],
                            test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split`: the lowest hashes of every label class, in the given share, are 'test'."""
    ranked = hash_rank(df, [label], keys, seed)
    n_test = F.round(F.col("group_rows") * test_share)
    return ranked.withColumn("split", F.when(F.col("hash_rank") <= n_test, "test").otherwise("train")
                             ).drop("hash_rank", "group_rows")


def split_counts(df: DataFrame, month: str = "month_slot", cutoff: str = fv.TEMPORAL_CUTOFF) -> DataFrame:
    edge = F.lit(cutoff).cast("date")
    return df.agg(F.count_if(F.col(month) < edge).alias("train_rows"),
                  F.count_if(F.col(month) >= edge).alias("test_rows"))


def temporal_split(df: DataFrame, label: str, keys: Sequence[str], month: str = "month_slot",
                   cutoff: str = fv.TEMPORAL_CUTOFF, method: str = "temporal") -> DataFrame:
    """Adds `split` and `split_method`. By default the month decides and rows without one drop
    out; `method='stratified'` asks for the stratified 80/20 of all rows instead. Few rows on a
    side never change the method: callers see them in `split_counts`."""
    if method == "stratified":
        return stratified_random_split(df, label, keys).withColumn("split_method", F.lit(method))
    if method != "temporal":
        raise ValueError(f"unknown split method {method}")
    edge = F.lit(cutoff).cast("date")
    return df.filter(F.col(month).isNotNull()).withColumn(
        "split", F.when(F.col(month) < edge, "train").otherwise("test")).withColumn("split_method", F.lit(method))


def uniform(keys: Sequence[str], seed: int | Column) -> Column:
    """A reproducible number in [0, 1) per key and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], seed), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number, by its cumulative probabilities."""
    term, total = 2.718281828459045 ** -1, 0.0
    column = None
    for k in range(9):
        total += term
        column = F.when(u < total, F.lit(float(k))) if column is None else column.when(
            u < total, F.lit(float(k)))
        term /= k + 1
    return column.otherwise(F.lit(9.0))
