"""People table to one row per household and month slot, in two explicit levels.

The second level averages the per-file means: merging the levels would change the result.
All aggregates combine map-side, so a household holding a large share of the rows costs
one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv

REDUCERS = {"min": F.min, "max": F.max, "mean": F.avg}


def _keys(df: DataFrame) -> list[str]:
    return [k for k in fv.HOUSEHOLD_KEYS if k in df.columns]


def _first_nonnull(column: str, order: Column) -> Column:
    """Value at the smallest order key among rows where the column is present."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def poi_household_agg(people: DataFrame) -> DataFrame:
    """First level: one row per source file and household. Rows with a null key drop out."""
    keys = _keys(people)
    member = F.struct("member_id") if "member_id" in people.columns else F.struct("household_id")
    return people.dropna(subset=keys).groupBy("file_stamp", *keys).agg(
        *[REDUCERS[how](source).alias(out)
          for source, (out, how) in fv.PEOPLE_AGGREGATES.items() if source in people.columns],
        *[_first_nonnull(source, member).alias(out)
          for source, out in fv.PEOPLE_CATEGORIES.items() if source in people.columns],
        F.count(F.lit(1)).alias("num_members"),
    )


def poi_reaggregate(per_file: DataFrame) -> DataFrame:
    """Second level: the same functions over files (mean of means for age)."""
    keys = _keys(per_file)
    return per_file.groupBy(*keys).agg(
        *[REDUCERS[how](out).alias(out)
          for out, how in fv.PEOPLE_AGGREGATES.values() if out in per_file.columns],
        *[_first_nonnull(out, F.struct("file_stamp")).alias(out)
          for out in fv.PEOPLE_CATEGORIES.values() if out in per_file.columns],
        F.max("num_members").alias("num_members"),
    )


def first_nonnull_by_order(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                           order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[_first_nonnull(c, F.struct(*order)).alias(f"{c}_first") for c in columns])


def household_mode(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """True mode per group; ties go to the smallest value."""
    return df.groupBy(*keys).agg(*[F.mode(c, True).alias(f"{c}_mode") for c in columns])
