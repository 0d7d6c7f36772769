"""A table with one row per key that micro-batches merge into, rewriting only what they touch.

Rows lie in hash buckets of their key. A batch reads the buckets its keys fall into, merges, and
writes these buckets whole into a folder of its own; every other bucket stays where an earlier batch
wrote it. Then it writes a pointer: for each bucket the batch that holds it. Readers follow the
newest pointer, so they see all of a batch or nothing of it. A batch that is replayed starts from
the pointer before it and writes the same again. What is written per batch therefore follows the
size of the touched buckets; choose `buckets` so that one holds some 100 MB.

Folders that no pointer of the last `keep` batches names are deleted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.sources.sinks import upsert_assessments

POINTER = "bucket int, written_by long"


class BucketedTable:
    """The newest row of every key, in `root`."""

    def __init__(self, spark: SparkSession, root: str, key: str = "conversation_id", order: str = "assessed_at",
                 buckets: int = 64, keep: int = 3):
        self.spark, self.root = spark, root.rstrip("/")
        self.key, self.order, self.buckets, self.keep = key, order, buckets, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def pointer(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it, as of the newest batch (before a given one)."""
        try:
            rows = self.spark.read.schema(f"{POINTER}, batch long").parquet(f"{self.root}/pointer")
        except AnalysisException:
            return {}
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
        return {r.bucket: r.written_by for r in rows.filter(F.col("batch") == newest).collect()} if newest is not None else {}

    def _paths(self, pointer: dict[int, int]) -> list[str]:
        return [f"{self.root}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(pointer.items())]

    def read(self) -> DataFrame:
        """All rows as of the newest batch."""
        paths = self._paths(self.pointer())
        if not paths:
            raise ValueError("no batch has been merged yet")
        return self.spark.read.parquet(*paths)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merges one micro-batch; made for `foreachBatch`. Rows with a null key count as one key."""
        batch = batch.withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets`
            if not touched:
                return
            pointer = self.pointer(before=batch_id)
            held = {bucket: pointer[bucket] for bucket in touched if bucket in pointer}
            incoming = batch.drop("bucket")
            existing = self.spark.read.schema(incoming.schema).parquet(*self._paths(held)) if held else incoming.limit(0)
            (upsert_assessments(existing, incoming, self.key, self.order).withColumn("bucket", self._bucket())
             .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={batch_id}"))
            now = {**pointer, **dict.fromkeys(touched, batch_id)}
            (self.spark.createDataFrame(sorted(now.items()), POINTER).coalesce(1)
             .write.mode("overwrite").parquet(f"{self.root}/pointer/batch={batch_id}"))
        finally:
            batch.unpersist()
        self._clean_up(batch_id)

    def _clean_up(self, batch_id: int) -> None:
        """Deletes pointers older than the kept ones, and buckets that no kept pointer names."""
        rows = self.spark.read.schema(f"{POINTER}, batch long").parquet(f"{self.root}/pointer").collect()  # kept + 1 pointers
        kept = sorted({r.batch for r in rows})[-self.keep:]
        named = {(r.written_by, r.bucket) for r in rows if r.batch in kept}
        for batch in {r.batch for r in rows} - set(kept):
            self._delete(f"{self.root}/pointer/batch={batch}")
        for batch, bucket in {(r.written_by, r.bucket) for r in rows} - named:
            self._delete(f"{self.root}/data/batch={batch}/bucket={bucket}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
