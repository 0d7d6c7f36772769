"""State with timers, expiry and resumption: each run of a stream is a restart."""

from datetime import datetime, timedelta

import pandas as pd
import pytest

from hearthline.streaming import sessions as ss
from hearthline.streaming import timers as tm
from hearthline.streaming import windows as w
from hearthline.streaming.runtime import StreamTable, stream_folder

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_state_partition(spark):
    """Every state partition starts Python workers of its own in each batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Stream:
    """A folder of events that grows, and the table a stream keeps of it. Every arrival is a new
    StreamTable object on the same folder, as after a restart."""

    def __init__(self, spark, path, schema, plan, clock="event"):
        self.spark, self.path, self.schema, self.plan, self.clock = spark, path, schema, plan, clock

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        table = StreamTable(self.spark, "t", f"{self.path}/out", timers=self.clock)
        return sorted((tuple(r) for r in table.append(self.plan(stream_folder(self.spark, f"{self.path}/in"))).collect()), key=str)


EVENTS = "domain string, assessed_at timestamp"


def at(key, seconds):
    return (key, START + timedelta(seconds=seconds))


def us(seconds):
    return int((START + timedelta(seconds=seconds) - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_a_key_that_stops_is_reported_while_it_is_silent(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), EVENTS, lambda df: tm.silences(df, 60, delay="10 seconds"))
    assert stream.arrive([at("a", 0), at("b", 0), at("a", 50), at("b", 50)]) == []
    # a stops; b goes on, and with it the stream's clock
    assert stream.arrive([at("b", 100)]) == []
    silent = ("a", "silent", us(50), None, 60.0)
    assert stream.arrive([at("b", 121)]) == [silent]
    assert stream.arrive([at("b", 180)]) == [silent]  # once, however long it lasts
    ended = ("a", "ended", us(50), us(200), 150.0)
    assert stream.arrive([at("a", 200), at("b", 200)]) == [ended, silent]
    # a gap that is over before the clock reaches its limit, and two in one batch
    rows = stream.arrive([at("a", 265), at("a", 400)])
    assert [r for r in rows if r not in (ended, silent)] == [
        ("a", "ended", us(200), us(265), 65.0), ("a", "ended", us(265), us(400), 135.0),
        ("a", "silent", us(200), None, 60.0), ("a", "silent", us(265), None, 60.0), ("b", "silent", us(200), None, 60.0)]


def test_an_alert_holds_without_events(spark, tmp_path):
    rule = tm.Rule(10, 40, 20, lambda n, baseline: n < 0.5 * baseline)
    stream = Stream(spark, str(tmp_path), EVENTS, lambda df: tm.held_alerts(df, rule, delay="0 seconds"))
    steady = [at("a", s) for s in range(0, 40)] + [at("b", s) for s in range(0, 40)]
    first = stream.arrive(steady)
    assert {(r[0], r[1] - us(0) // 10 ** 6, r[2], r[4]) for r in first} == {(k, b, 10, False) for k in "ab" for b in (0, 10, 20)}
    rows = {(r[0], r[1] - us(0) // 10 ** 6): r[2:] for r in stream.arrive([at("b", s) for s in range(40, 81)])}
    # a has no event after second 40: its buckets are closed by b's
    assert rows["a", 40] == (0, 8.0, True, False) and rows["a", 50] == (0, 6.0, True, False)
    assert rows["a", 60] == (0, 4.0, True, True) and rows["a", 70] == (0, 2.0, True, True)
    assert all(not rows["b", b][2] for b in range(0, 80, 10))


def test_partitions_are_reduced_to_buckets():
    frames = [pd.DataFrame({"key": ["d", None] * 250, "us": range(i * 500, i * 500 + 500)}) for i in range(4)]
    out = pd.concat(tm.bucket_totals(iter(frames), 1000))
    assert out.astype(object).where(out.notna(), None).values.tolist() == [
        ["d", 0, 0, 998, 500], [None, 0, 1, 999, 500], ["d", 1, 1000, 1998, 500], [None, 1, 1001, 1999, 500]]


ANSWERS = "session string, message_id long, text string"


def held(spark, path, variable):
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return reader.load(f"{path}/out/checkpoint").count()


def test_replays_use_up_no_step_and_finished_sessions_leave_the_state(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), ANSWERS, ss.session_profile_state, "processing")
    first = [("s", i, f"{i}") for i in range(1, 11)] + [("unfinished", 1, "x")]
    assert stream.arrive(first) == []
    assert held(spark, tmp_path, "answers") == 11
    assert stream.arrive(first + first) == [] and held(spark, tmp_path, "answers") == 11
    done = stream.arrive([("s", i, f"{i}") for i in range(8, 16)])
    assert done == [("s", [str(i) for i in range(1, 16)])]
    assert held(spark, tmp_path, "answers") == 1 and held(spark, tmp_path, "finished") == 1
    assert stream.arrive([("s", i, "again") for i in range(1, 40)]) == done
    assert held(spark, tmp_path, "answers") == 1


def test_a_session_takes_few_calls_of_the_state_store():
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def __getattr__(self, method):
            def call(*values):
                calls.append((self.name, method))
                if method == "get":
                    return iter(self.held)
                if method in ("appendList", "put", "clear"):
                    self.held = (self.held if method == "appendList" else []) + (values[0] if values else [])
                return False
            return call

    class Handle:
        def getListState(self, name, *_):
            return State(name)

        getValueState = getMapState = getListState

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentProcessingTimeInMs(self):
            return self.now

    def arrive(messages, now):
        calls.clear()
        return list(session.handleInputRows(("s",), iter([{"message_id": i, "text": str(i)} for i in messages]), Clock(now)))

    session = ss.SessionAnswers(timedelta(milliseconds=100), timedelta(days=7))
    session.init(Handle())
    assert arrive(range(1, 9), 0) == [] and len(calls) <= 3
    assert arrive([1, 9], 60) == [] and len(calls) <= 3 and len(session.answers.held) == 9
    assert arrive([10], 120) == [] and sorted(m for m, _, _ in session.answers.held) == [1, 9, 10]  # each expires by its own time
    assert [r.answers for r in arrive(range(20, 32), 130)] == [[str(i) for i in (1, 9, 10, *range(20, 32))]] and len(calls) <= 4


def test_state_expires(spark, tmp_path):
    soon = timedelta(milliseconds=1)
    stream = Stream(spark, str(tmp_path), ANSWERS, lambda df: ss.session_profile_state(df, soon, soon), "processing")
    stream.arrive([("s", i, "x") for i in range(1, 16)] + [("unfinished", 1, "x")])
    stream.arrive([("other", 1, "x")])
    assert held(spark, tmp_path, "finished") == 0
    # a session whose mark has expired may be filled again
    assert len(stream.arrive([("s", i, "y") for i in range(1, 16)])) == 2


def test_another_object_resumes_a_stream(spark, tmp_path):
    schema = "assessed_at timestamp, domain string"

    def arrive(seconds):
        spark.createDataFrame([(START + timedelta(seconds=s), "d") for s in seconds], schema).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in")
        counted = w.prediction_counts(stream_folder(spark, f"{tmp_path}/in"), delay="0 seconds")
        return sorted(r.n for r in StreamTable(spark, "t", f"{tmp_path}/out").append(counted).collect())

    assert arrive([0, 10, 400]) == [2]
    assert arrive([410, 700]) == [2, 2]  # the event of second 400 was kept by the first run


@pytest.mark.parametrize("rule", [tm.VOLUME_DROP, tm.HIGH_STRESS_SURGE])
def test_rules_are_those_of_the_batch_alerts(rule):
    assert rule.span_seconds % rule.bucket_seconds == 0 and rule.hold_seconds > 0
