"""Boosted trees as flat arrays: scores and the share of every feature in one Arrow pass.

A saved ensemble is a table with one row per node. Laid out as arrays it is a few megabytes at
most, set by rounds and depth and not by the data, so tasks get it with the plan's closure.

The share of a feature in a row's margin is the sum, over all trees, of the change in the node's
value at every split on that feature along the row's path; the values at the roots add up to the
bias, so bias plus shares is the margin. Nothing is shuffled and no row is copied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = -1


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees; `value` is weighted by the tree's weight, children are node numbers."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @property
    def bias(self) -> float:
        return float(self.value[self.roots].sum())

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each feature in the margin of each row of `x`."""
        out = np.zeros(x.shape)
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            rows = np.flatnonzero(self.feature[node] != LEAF)
            while len(rows):
                here = node[rows]
                split = self.feature[here]
                there = np.where(x[rows, split] <= self.threshold[here], self.left[here], self.right[here])
                out[rows, split] += self.value[there] - self.value[here]
                node[rows] = there
                rows = rows[self.feature[there] != LEAF]
        return out


def read_trees(spark: SparkSession, path: str) -> FlatTrees:
    """The trees of a saved ensemble over numeric features."""
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    split = F.col("nodeData.split")
    nodes = (spark.read.parquet(f"{path}/data").join(F.broadcast(weights), "treeID")  # one row per tree
             .select("treeID", F.col("nodeData.id").alias("id"), (F.col("nodeData.prediction") * F.col("weight")).alias("value"),
                     F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                     split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"),
                     F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
             .orderBy("treeID", "id").toPandas())
    if (nodes["categories"] > 0).any():
        raise ValueError("splits on category sets are not supported")
    first = np.flatnonzero(nodes["id"] == 0)
    base = np.repeat(first, np.diff([*first, len(nodes)]))
    feature = nodes["feature"].to_numpy(np.int32)
    inner = feature != LEAF
    return FlatTrees(feature, nodes["threshold"].fillna(0.0).to_numpy(), np.where(inner, nodes["left"] + base, 0),
                     np.where(inner, nodes["right"] + base, 0), nodes["value"].to_numpy(), first)


EXPLAINED = "probability double, margin double, bias double, shares array<double>"


def explain(df: DataFrame, trees: FlatTrees, features: str = "x") -> DataFrame:
    """Adds probability, margin, bias and the share of every feature, from the feature array
    `features`, which is dropped."""
    kept = [c for c in df.columns if c != features]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != features)

    def run(batches):
        for batch in batches:
            flat = batch.column(batch.schema.get_field_index(features)).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            shares = trees.shares(x)
            margin = trees.bias + shares.sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, shares.shape[1]), pa.int32()), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(1 / (1 + np.exp(-2 * margin))), pa.array(margin),
                 pa.array(np.full(len(margin), trees.bias)), lists],
                names=[*kept, "probability", "margin", "bias", "shares"])

    return df.select(*kept, features).mapInArrow(run, f"{schema}, {EXPLAINED}" if schema else EXPLAINED)
