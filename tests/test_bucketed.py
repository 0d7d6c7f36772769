"""Micro-batches merged into buckets: what is written, replayed and cleaned up."""

import random
from pathlib import Path

import pytest

from hearthline.streaming.bucketed import BucketedTable

SCHEMA = "conversation_id long, assessed_at long, value double"


def folders(root):
    return {(int(p.parent.name[6:]), int(p.name[7:])) for p in Path(root).glob("data/batch=*/bucket=*")}


def rows_of(table):
    return sorted(tuple(r) for r in table.read().select("conversation_id", "assessed_at", "value").collect())


def newest(rows):
    """The newest row of each key; at equal times the later one."""
    kept = {}
    for row in rows:
        if row[0] not in kept or row[1] >= kept[row[0]][1]:
            kept[row[0]] = row
    return sorted(kept.values())


def test_batches_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    rng, seen = random.Random(3), []
    for batch in range(5):
        table = BucketedTable(spark, str(tmp_path), buckets=8, keep=2)  # a new object, as after a restart
        n = 200 if batch == 0 else 2
        rows = [(rng.randrange(100), rng.randrange(1000) + batch, float(batch * 1000 + i)) for i in range(n)]
        rows = list({(r[0], r[1]): r for r in rows}.values())
        seen += rows
        table.merge(spark.createDataFrame(rows, SCHEMA), batch)
        assert rows_of(table) == newest(seen)
        written = {bucket for by, bucket in folders(tmp_path) if by == batch}
        assert len(written) == 8 if batch == 0 else 0 < len(written) <= 2
    assert len(list(Path(tmp_path).glob("pointer/batch=*"))) == 2
    # every bucket has its present place, and at most those of the one pointer before
    assert 8 <= len(folders(tmp_path)) <= 10


def test_replays_and_lost_pointers_change_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), buckets=4)
    first = [(i, 1, 1.0) for i in range(20)]
    second = [(i, 2, 2.0) for i in range(0, 20, 7)] + [(99, 1, 5.0)]
    table.merge(spark.createDataFrame(first, SCHEMA), 0)
    pointed = table.pointer()
    # a batch that died before its pointer is not seen ...
    spark.createDataFrame(second, SCHEMA).write.parquet(f"{tmp_path}/data/batch=1/bucket=0")
    assert table.pointer() == pointed and rows_of(table) == newest(first)
    # ... and its replay, once or twice, gives the same table
    for _ in range(2):
        table.merge(spark.createDataFrame(second, SCHEMA), 1)
        assert rows_of(table) == newest(first + second)


def test_empty_batches_null_keys_and_no_batch(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), buckets=4)
    with pytest.raises(ValueError):
        table.read()
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    assert table.pointer() == {}
    table.merge(spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], SCHEMA), 1)
    assert [tuple(r) for r in table.read().select("assessed_at", "value").collect()] == [(2, 2.0)]
