"""Candidate pairs from inverted lists, enough for components but far fewer than all pairs.

A list has rows of (value, node, about, component): the nodes that share `value`, what is known
about each for a cheap test, and the component each belongs to so far. `near(x, y)` is that test,
over two such columns; it lets every link through and is part of the join, so that pairs which
fail it are never made. Pairs are ordered, a < b.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Near = Callable[[Column, Column], Column]

#: Rows up to which a written table of one or two numbers a row may be broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`written`, a narrow table in Parquet, to be broadcast only if it was counted to be small;
    beyond that the join shuffles."""
    return F.broadcast(written) if written.count() <= rows else written


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def star_pairs(lists: DataFrame, leading: DataFrame, near: Near) -> DataFrame:
    """In each list, the first class of `leading` against the list's members elsewhere."""
    leaders = (leading.groupBy("value").agg(F.min_by(F.struct("node", "component", "about"), "node").alias("lead"))
               .select("value", "lead.*").toDF("list", "lead", "lead_component", "lead_about"))
    return (lists.join(leaders, (F.col("value") == F.col("list")) & (F.col("component") != F.col("lead_component"))
                       & near(F.col("about"), F.col("lead_about")))
            .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct())


def others(lists: DataFrame) -> DataFrame:
    """Lists without the members of their first class's component, where others remain."""
    leaders = lists.groupBy("value").agg(F.min_by("component", "node").alias("lead_component"))
    return lists.join(leaders, "value").filter("component != lead_component").drop("lead_component")


def apart_pairs(lists: DataFrame, near: Near) -> DataFrame:
    """All pairs in a list that are still in different components: those outside the list's
    largest component, against everything elsewhere."""
    counts = lists.groupBy("value", "component").agg(F.count("*").alias("k"))
    main = (counts.groupBy("value").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1"))
    few = lists.join(main, "value").filter("component != main").select(
        F.col("value").alias("list"), F.col("node").alias("x"), F.col("about").alias("x_about"),
        F.col("component").alias("x_component"), "main")
    return (few.join(lists, (F.col("value") == F.col("list")) & F.expr(
                "component != x_component and (component = main or node > x)") & near(F.col("about"), F.col("x_about")))
            .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())


def labelled(lists: DataFrame, components: DataFrame) -> DataFrame:
    found = components.select("node", F.col("component").alias("found"))
    return lists.drop("component").join(found, "node", "left").select(
        "value", "node", "about", F.coalesce("found", "node").alias("component"))
