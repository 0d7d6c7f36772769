"""Bounded samples of labelled rows for fitting classifiers, drawn by hash without gathering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.lists import broadcast_if_small
from hearthline.session import cut_lineage


def bounded_per_class(rows: DataFrame, label: str, bound: int, key: str = "doc_id") -> DataFrame:
    """At most `bound` rows of every class: those with the smallest hashes of `key`.

    `rows` has the class in `label` and the key only. Classes are thinned by a hash threshold
    set from their counts first, so the ranking window sees about 1.2 x bound rows a class.
    """
    rows = rows.withColumn("draw", F.xxhash64(F.lit("draw"), key).bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62))
    counts = rows.groupBy(label).agg(F.count("*").alias("class_rows"))
    thinned = (rows.join(broadcast_if_small(cut_lineage(counts)), label)
               .filter(F.col("draw") * F.col("class_rows") <= F.lit(1.2 * bound + 50)))
    ranked = Window.partitionBy(label).orderBy("draw", key)
    return thinned.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= bound).select(*[
        c for c in rows.columns if c != "draw"])


def texts_of(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """`label` and text of the sampled rows; the sample has a fixed bound, so it is broadcast."""
    left = docs.select(F.col("doc_id").alias("sample_doc_id"), F.col("text").cast("string").alias("sample_text"))
    right = sample.select("doc_id", label)
    return (left.join(F.broadcast(right), F.col("sample_doc_id") == F.col("doc_id"))
            .select("doc_id", label, F.col("sample_text").alias("text")))
