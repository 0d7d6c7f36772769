"""Joins between the surveys and over the assessment store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.operators.cleaning import resolve_duplicate_columns
from hearthline.operators.order_stats import long_form


def match_month_pairs(left: DataFrame, right: DataFrame, stamp: str = "file_stamp") -> DataFrame:
    """Stamps present on both sides."""
    return left.select(stamp).distinct().join(right.select(stamp).distinct(), stamp, "left_semi")


def join_income_consumption(inc: DataFrame, con: DataFrame) -> DataFrame:
    """Inner join on household, month slot and reference month, within one source month.

    Null keys match null keys, hence `eqNullSafe`; Spark still extracts hash keys from it.
    """
    keys = [k for k in fv.MONTHLY_KEYS if k in inc.columns and k in con.columns]
    if "file_stamp" in inc.columns and "file_stamp" in con.columns:
        keys = ["file_stamp"] + keys
    right = resolve_duplicate_columns(inc, con, keys).alias("con")
    left = inc.alias("inc")
    match: Column = F.lit(True)
    for i, k in enumerate(keys):
        equal = F.col(f"inc.{k}").eqNullSafe(F.col(f"con.{k}"))
        match = equal if i == 0 else match & equal
    extra = [f"con.{c}" for c in right.columns if c not in keys]
    return left.join(right, match, "inner").select("inc.*", *extra)


def join_people(df: DataFrame, people: DataFrame) -> DataFrame:
    """Left join of the household people aggregate (its keys are never null)."""
    keys = [k for k in fv.HOUSEHOLD_KEYS if k in people.columns]
    return df.join(resolve_duplicate_columns(df, people, keys), keys, "left")


def user_assessments(assessments: DataFrame, conversations: DataFrame,
                     user_id: int | None = None) -> DataFrame:
    """Assessments reached through a user's conversations, newest first."""
    owned = conversations.filter(F.col("user_id").isNotNull())
    if user_id is not None:
        owned = owned.filter(F.col("user_id") == user_id)
    owned = owned.select("conversation_id", "user_id")
    return (assessments.drop("user_id").join(owned, "conversation_id")
            .orderBy(F.desc("assessed_at"), F.desc("conversation_id")))


def assessments_with_session(assessments: DataFrame, conversations: DataFrame,
                             limit: int = 50) -> DataFrame:
    """Newest assessments that carry a confidence, with the session of their conversation.

    The limit runs before the lookup: a top-k of the assessments, then a join of k rows.
    """
    newest = (assessments.filter(F.col("prediction_confidence").isNotNull())
              .orderBy(F.desc("assessed_at"), F.desc("conversation_id")).limit(limit))
    sessions = conversations.select("conversation_id", "session_id")
    return (newest.join(sessions, "conversation_id", "left")
            .orderBy(F.desc("assessed_at"), F.desc("conversation_id")))


def prior_of_state(state: Column | str) -> Column:
    """Fixed 17-entry lookup as a literal map: no join, no shuffle."""
    pairs = F.create_map(*[F.lit(x) for pair in fv.STATE_PRIORS.items() for x in pair])
    column = F.col(state) if isinstance(state, str) else state
    return F.coalesce(F.try_element_at(pairs, column), F.lit(fv.DEFAULT_STATE_PRIOR))


def state_prior_lookup(df: DataFrame, state: str = "state") -> DataFrame:
    return df.withColumn("state_prior", prior_of_state(state))


def bounds_check(df: DataFrame, bounds: DataFrame, keys: Sequence[str],
                 features: Sequence[str]) -> DataFrame:
    """Feature values strictly outside their p1-p99 bounds, one row per finding.

    `bounds` has one row per feature, so it is as small as the feature list.
    """
    long = long_form(df, features, keys).filter(F.col("value").isNotNull())
    outside = (F.col("value") < F.col("p1")) | (F.col("value") > F.col("p99"))
    return long.join(F.broadcast(bounds), "feature").filter(outside)


def warning_text(feature: Column, value: Column, low: Column, high: Column) -> Column:
    return F.format_string("%s=%.2f outside expected range [%.2f, %.2f] (training p1-p99)", feature, value, low, high)


def bounds_warning() -> Column:
    return warning_text(F.col("feature"), F.col("value"), F.col("p1"), F.col("p99"))


def orphan_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left table without a partner on the right."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")
