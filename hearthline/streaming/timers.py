"""Conditions that must speak up by themselves: keyed state with event-time timers.

A query that only reacts to rows cannot report that no rows come. Here each key keeps a timer;
when the watermark passes it, the key reports without any event of its own. The watermark is that
of the whole stream, so it moves on while one key is silent.

Events never reach the keyed state one by one. Each partition is first reduced to one row per key and time
bucket, so a key with a third of all events costs a task what a quiet key does, and the state
holds a bounded number of numbers per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND_US = 1_000_000
#: Buckets that a task holds before it passes them on.
HELD_BUCKETS = 100_000
BUCKETS = "key string, bucket long, first_us long, last_us long, n long"
SILENCES = "key string, kind string, gap_start_us long, gap_end_us long, gap_seconds double"
SERIES = "key string, bucket long, n long, baseline double, firing boolean, alert boolean"


def bucket_totals(frames: Iterator[pd.DataFrame], width_us: int) -> Iterator[pd.DataFrame]:
    """First and last event and number of events per (key, bucket) of a partition, in bounded frames."""
    held: dict[tuple, tuple[int, int, int]] = {}

    def shown() -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["key", "bucket", "first_us", "last_us", "n"])

    for frame in frames:
        totals = frame.groupby(["key", frame["us"] // width_us], dropna=False)["us"].agg(["min", "max", "size"])
        for (key, bucket), first, last, n in totals.itertuples():
            at = (None if pd.isna(key) else key, bucket)
            a, b, m = held.get(at, (first, last, 0))
            held[at] = (min(a, first), max(b, last), m + n)
        if len(held) >= HELD_BUCKETS:
            yield shown()
            held.clear()
    if held:
        yield shown()


def reduced(stream: DataFrame, key: str, ts: str, width_us: int, delay: str) -> DataFrame:
    """`stream` as BUCKETS rows with a watermark on the time of a bucket's last event."""
    timed = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    totals = timed.filter("us is not null").mapInPandas(lambda frames: bucket_totals(frames, width_us), BUCKETS)
    return totals.withColumn("seen", F.timestamp_micros("last_us")).withWatermark("seen", delay)


class SilenceTimers(StatefulProcessor):
    """Per key, one row when a silence reaches the limit and one when it ends."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last_us long, timer_ms long, reported boolean")

    def handleInputRows(self, key, rows, timerValues):
        ends = sorted((first, last) for frame in rows for first, last in zip(frame["first_us"].tolist(), frame["last_us"].tolist()))
        last_us, timer_ms, reported = self.state.get() if self.state.exists() else (None, None, False)
        out = []
        for first, last in ends:
            if last_us is not None and first - last_us > self.limit_us:
                if not reported:
                    out.append(self.started(key, last_us))
                out.append((key[0], "ended", last_us, first, (first - last_us) / SECOND_US))
            if last_us is None or last > last_us:
                last_us, reported = last, False
        expiry_ms = -(-(last_us + self.limit_us) // 1000)
        if timer_ms != expiry_ms and not reported:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            self.handle.registerTimer(expiry_ms)
        self.state.update((last_us, expiry_ms, reported))
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "gap_start_us", "gap_end_us", "gap_seconds"]).astype({"gap_end_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last_us, timer_ms, reported = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() == timer_ms and not reported:
            self.state.update((last_us, timer_ms, True))
            yield pd.DataFrame([self.started(key, last_us)], columns=["key", "kind", "gap_start_us", "gap_end_us", "gap_seconds"]).astype(
                {"gap_end_us": "Int64"})

    def started(self, key, last_us: int) -> tuple:
        return (key[0], "silent", last_us, None, self.limit_us / SECOND_US)

    def close(self) -> None:
        pass


def silences(stream: DataFrame, limit_seconds: int, key: str = "domain", ts: str = "assessed_at",
             delay: str = "10 minutes") -> DataFrame:
    """`silent` rows as soon as a key has had no event for the limit, `ended` rows when it speaks again.

    A silence that goes on is reported once, by a timer; one that ended before the watermark
    reached its limit is reported by the event that ended it. Keys never heard of cannot be silent.
    """
    limit_us = limit_seconds * SECOND_US
    return reduced(stream, key, ts, limit_us, delay).groupBy("key").transformWithStateInPandas(
        SilenceTimers(limit_us), SILENCES, "append", "eventTime")


@dataclass(frozen=True)
class Rule:
    """When a bucket's count counts as an alarm, given the mean of the trailing span."""

    bucket_seconds: int
    span_seconds: int
    hold_seconds: int
    firing: Callable[[int, float], bool]


VOLUME_DROP = Rule(300, 3600, 600, lambda n, baseline: n < 0.5 * baseline)
HIGH_STRESS_SURGE = Rule(3600, 7 * 86400, 1800, lambda n, baseline: n > 1.2 * baseline)


class HeldAlerts(StatefulProcessor):
    """Per key, one row for each bucket that has ended, events or not, with its alert.

    State: the counts of the trailing span and of buckets still open, and where the present run
    of firing buckets began. A timer stands at the end of the next bucket to be closed.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bucket long", "n long")
        self.place = handle.getValueState("place", "first long, next long, run_start long")

    def handleInputRows(self, key, rows, timerValues):
        size, first = self.rule.bucket_seconds, None
        for frame in rows:
            for bucket, n in zip(frame["bucket"].tolist(), frame["n"].tolist()):
                at = bucket * size
                known = self.counts.getValue((at,)) if self.counts.containsKey((at,)) else (0,)
                self.counts.updateValue((at,), (known[0] + n,))
                first = at if first is None else min(first, at)
        if self.place.exists():
            start, upcoming, run = self.place.get()
            if start == upcoming and first is not None and first < start:  # nothing closed yet
                self.handle.deleteTimer((start + size) * 1000)
                self.handle.registerTimer((first + size) * 1000)
                self.place.update((first, first, run))
        elif first is not None:
            self.place.update((first, first, -1))
            self.handle.registerTimer((first + size) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rule, out = self.rule, []
        first, at, run_start = self.place.get()
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        watermark = timerValues.getCurrentWatermarkInMs()
        while (at + rule.bucket_seconds) * 1000 <= watermark:
            begin = max(first, at - rule.span_seconds)
            trailing = [counts.get(b, 0) for b in range(begin + (at - begin) % rule.bucket_seconds, at + 1, rule.bucket_seconds)]
            n, baseline = counts.get(at, 0), sum(trailing) / len(trailing)
            firing = bool(rule.firing(n, baseline))
            run_start = (at if run_start < 0 else run_start) if firing else -1
            out.append((key[0], at, n, baseline, firing, firing and at - run_start >= rule.hold_seconds))
            at += rule.bucket_seconds
        for bucket in [b for b in counts if b < at - rule.span_seconds]:
            self.counts.removeKey((bucket,))
        self.place.update((first, at, run_start))
        self.handle.registerTimer((at + rule.bucket_seconds) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["key", "bucket", "n", "baseline", "firing", "alert"])

    def close(self) -> None:
        pass


def held_alerts(stream: DataFrame, rule: Rule, key: str = "domain", ts: str = "assessed_at", delay: str = "10 minutes") -> DataFrame:
    """Every ended bucket of every key, from its first event on, with count, trailing mean and alert.

    An alert stands once the condition has held for the rule's time, and is raised for buckets
    without events as well: the stream's watermark closes them.
    """
    width_us = rule.bucket_seconds * SECOND_US
    return reduced(stream, key, ts, width_us, delay).groupBy("key").transformWithStateInPandas(
        HeldAlerts(rule), SERIES, "append", "eventTime")
