"""Sources, sinks and streams on small files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from hearthline.session import shared_dir
from hearthline.sources import raw as r
from hearthline.sources import sinks as s
from hearthline.streaming import sessions as ss
from hearthline.streaming import windows as w
from hearthline.streaming.runtime import StreamTable, stream_folder


def test_zip_archives(spark, tmp_path):
    for stamp, body in (("20200131", "HH_ID,TOT_INC\nh1,NaN\nh2,-99\n"), ("20200229", "HH_ID,EXTRA\nh3,x\n")):
        with zipfile.ZipFile(tmp_path / f"inc_{stamp}_MS.zip", "w") as z:
            z.writestr("data.csv", body)
    rows = {x.HH_ID: x for x in r.ingest_raw_zip(spark, str(tmp_path), ["HH_ID", "TOT_INC"]).collect()}
    assert rows["h1"].TOT_INC == "NaN" and rows["h2"].file_stamp == "20200131"
    assert rows["h3"].TOT_INC is None and rows["h3"].file_stamp == "20200229"


def test_union_schema_first_type_wins(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, "x", "new"), (3, "4.5", "new")], "k int, v string, extra string")
    rows = {x.k: x for x in r.merge_union_schema([a, b]).collect()}
    assert rows[2].v is None and rows[3].v == 4.5 and rows[1].extra is None


def test_incremental_months(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("20200131", 1), ("20200229", 2)], "file_stamp string, v int")
    assert s.incremental_skip_done(df, path).count() == 2
    s.write_month_partitions(df.filter("v = 1"), path)
    assert [x.v for x in s.incremental_skip_done(df, path).collect()] == [2]
    s.write_month_partitions(df.filter("v = 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_upsert_prefers_newest_then_incoming(spark):
    old = spark.createDataFrame([(1, "2024-01-01", 0.1), (2, "2024-01-05", 0.2)], "conversation_id int, assessed_at string, p double")
    new = spark.createDataFrame([(1, "2024-01-01", 0.9), (2, "2024-01-01", 0.9), (3, "2024-01-01", 0.3)],
                                "conversation_id int, assessed_at string, p double")
    assert {x.conversation_id: x.p for x in s.upsert_assessments(old, new).collect()} == {1: 0.9, 2: 0.2, 3: 0.3}


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def predictions(spark, path, rows):
    df = spark.createDataFrame(rows, "conversation_id long, ts string, domain string, probability double, latency double")
    df.select("conversation_id", F.col("ts").cast("timestamp_ntz").alias("assessed_at"), "domain", "probability",
              "latency").coalesce(1).write.mode("append").parquet(path)
    return stream_folder(spark, path)


def test_late_rows_are_dropped_after_a_restart(spark, tmp_path):
    path, table = str(tmp_path / "in"), StreamTable(spark, "t")
    on_time = [(1, "2024-01-01 00:01:00", "d", 0.9, 1.0), (2, "2024-01-01 02:00:00", "d", 0.9, 1.0)]
    first = table.append(w.prediction_counts(predictions(spark, path, on_time))).collect()
    assert [x.n for x in first] == [1]
    late = [(3, "2024-01-01 00:02:00", "d", 0.9, 1.0), (4, "2024-01-01 04:00:00", "d", 0.9, 1.0)]
    after = table.append(w.prediction_counts(predictions(spark, path, late))).collect()
    assert sorted(x.n for x in after) == [1, 1]


def test_replayed_predictions_count_once(spark, tmp_path):
    path, table = str(tmp_path / "in"), StreamTable(spark, "t")
    row = (1, "2024-01-01 00:01:00", "d", 0.9, 1.0)
    table.append(w.dedup_predictions(predictions(spark, path, [row, row])))
    assert table.append(w.dedup_predictions(predictions(spark, path, [row]))).count() == 1


def test_sessions_fill_over_several_runs(spark, tmp_path):
    path, table = str(tmp_path / "in"), StreamTable(spark, "t", timers="processing")

    def arrive(rows):
        spark.createDataFrame(rows, "session string, message_id long, text string").coalesce(1).write.mode("append").parquet(path)
        return table.append(ss.session_profile_state(stream_folder(spark, path)))

    assert arrive([("s", i, "goa" if i == 1 else f"{i}") for i in range(1, 11)]).count() == 0
    done = arrive([("s", i, f"{i}") for i in range(20, 10, -1)])
    assert done.count() == 1 and done.first().answers[14] == "15"
    assert arrive([("s", 30, "again")]).count() == 1
    assert ss.typed_profiles(done).first().state == "Goa"


def test_silence_over_runs(spark, tmp_path):
    path, table = str(tmp_path / "in"), StreamTable(spark, "t")
    table.append(ss.silence_alerts(predictions(spark, path, [(1, "2024-01-01 00:00:00", "d", 0.1, 1.0)]), 30))
    out = table.append(ss.silence_alerts(predictions(spark, path, [(2, "2024-01-01 00:01:00", "d", 0.1, 1.0)]), 30))
    assert [x.gap_seconds for x in out.collect()] == [pytest.approx(60.0)]


def test_csv_headers_may_drift(spark, tmp_path):
    files = {"inc_20200101.csv": "HH_ID,TOT_INC\n1,10\n2,20\n", "inc_20200201.csv": "TOT_INC,HH_ID\n30,3\n",
             "inc_20200301.csv": "HH_ID,TOT_INC,EXTRA\n4,40,x\n", "inc_20200401.csv": "HH_ID\n5\n"}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    rows = sorted(tuple(x) for x in r.ingest_raw_csv(spark, str(tmp_path), ["HH_ID", "TOT_INC", "EXTRA"]).collect())
    assert rows == [("1", "10", None, "20200101"), ("2", "20", None, "20200101"), ("3", "30", None, "20200201"),
                    ("4", "40", "x", "20200301"), ("5", None, None, "20200401")]


def test_archives_with_two_members_lose_nothing(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "inc_20200101.zip", "w") as archive:
        archive.writestr("a.csv", "HH_ID,TOT_INC\n1,10\n")
        archive.writestr("b.csv", "TOT_INC,HH_ID\n20,2\n")
    rows = sorted(tuple(x) for x in r.ingest_raw_zip(spark, str(tmp_path), ["HH_ID", "TOT_INC"]).collect())
    assert rows == [("1", "10", "20200101"), ("2", "20", "20200101")]
