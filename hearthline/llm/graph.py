"""Connected components of large graphs, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """`node` and the smallest node of its `component`, for every node of the edges.

    A distributed union-find: edges are hung under ever smaller neighbours (large star, then
    small star) until every node points at its component's smallest one. Each round is two
    aggregations and joins, is written to the shared folder, and rounds grow with the logarithm
    of the longest path. Null ends and self loops are left out.
    """
    now = (edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
           .filter("u is not null and v is not null and u != v").distinct())
    now = cut_lineage(now)
    mark = _fingerprint(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(below, "u")
        small = (hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(below.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = cut_lineage(small)
        after = _fingerprint(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(now.select("v", "v").distinct())
