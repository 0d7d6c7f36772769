"""Queries that run as streams over the event table's files, then read what was written.

In append mode a window is written once the watermark has passed its end, so the SQL keeps
the windows that ended before the last event minus the allowed delay.
"""

from pyspark.sql import functions as F

from hearthline.catalog.alerts import alerting
from hearthline.catalog.answers import PROFILE
from hearthline.catalog.oracle_views import over
from hearthline.catalog.registry import micros, query
from hearthline.catalog.survey_views import prediction_log_of
from hearthline.session import shared_dir
from hearthline.streaming import sessions as ss
from hearthline.streaming import timers as tm
from hearthline.streaming import windows as w
from hearthline.streaming.bucketed import BucketedTable
from hearthline.streaming.runtime import StreamTable, stream_folder

DOMAIN = {"purchase": "financial_stress", "view": "food_stress", "click": "debt_stress", "signup": "health_stress"}


def domain():
    column = None
    for event, name in DOMAIN.items():
        matched = F.col("event_type") == event
        column = F.when(matched, name) if column is None else column.when(matched, name)
    return column.otherwise("composite")


def predictions(t):
    events = stream_folder(t.spark, t.sf_dir, "events.parquet", t.table("events").schema)
    return prediction_log_of(events, domain())


def closed(size: int, delay: int = 600, where: str = "true", log: str = "prediction_log") -> str:
    start = f"cast(floor(epoch_us(assessed_at) / 1000000) AS BIGINT) // {size} * {size}"
    return f"""(SELECT *, {start} AS start_s FROM {log}
                WHERE {where} AND ({start} + {size}) * 1000000 <= (SELECT max(epoch_us(assessed_at)) FROM {log} WHERE {where}) - {delay} * 1000000::BIGINT)"""


def start_seconds(df, column: str = "window_start"):
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1000000).cast("long").alias("start_s")


@query("stream_prediction_counts", over(f"""
    SELECT start_s, domain, count(*) AS n FROM {closed(300)} GROUP BY 1, 2""", "prediction_log"))
def stream_prediction_counts(t):
    out = StreamTable(t.spark, "prediction-counts").append(w.prediction_counts(predictions(t)))
    return out.select(start_seconds(out), "domain", "n")


@query("stream_high_stress_counts", over(f"""
    SELECT start_s, domain, count(*) AS n FROM {closed(3600, where="probability >= 0.5")} GROUP BY 1, 2""",
    "prediction_log"))
def stream_high_stress_counts(t):
    out = StreamTable(t.spark, "high-stress").append(w.high_stress_counts(predictions(t)))
    return out.select(start_seconds(out), "domain", "n")


@query("stream_latency_p99", over(f"""
    SELECT start_s, count(*) AS n, CASE WHEN max(latency) > 2 THEN 'critical' WHEN max(latency) > 0.5 THEN 'warning' ELSE 'ok' END
           AS severity FROM {closed(300)} GROUP BY 1""", "prediction_log"))
def stream_latency_p99(t):
    # windows here hold fewer than 100 rows, whose 99th percentile is their largest value
    out = StreamTable(t.spark, "latency").append(w.latency_p99(predictions(t)))
    return out.select(start_seconds(out), "n", "severity")


@query("stream_trailing_counts", over("""
    SELECT (start_s + 3600) * 1000000 AS window_end_us, domain, count(*) AS n FROM (
    SELECT domain, unnest(generate_series(slide - 3300, slide, 300)) AS start_s FROM (
        SELECT domain, cast(floor(epoch_us(assessed_at) / 1000000) AS BIGINT) // 300 * 300 AS slide FROM prediction_log))
    WHERE (start_s + 3600) * 1000000 <= (SELECT max(epoch_us(assessed_at)) // 1000 * 1000 FROM prediction_log) - 600 * 1000000::BIGINT
    GROUP BY 1, 2""", "prediction_log"))
def stream_trailing_counts(t):
    return StreamTable(t.spark, "trailing").append(w.trailing_counts(predictions(t))).select(
        micros("window_end", "window_end_us"), "domain", "n")


@query("stream_session_durations", over("""
    SELECT user_id, epoch_us(min(assessed_at)) AS start_us, epoch_us(max(assessed_at)) + 1800 * 1000000 AS end_us, count(*) AS n
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY assessed_at) AS run FROM (
          SELECT *, CASE WHEN epoch_us(assessed_at) - epoch_us(lag(assessed_at) OVER (PARTITION BY user_id ORDER BY assessed_at))
                    < 1800 * 1000000 THEN 0 ELSE 1 END AS fresh FROM prediction_log))
    GROUP BY user_id, run
    HAVING epoch_us(max(assessed_at)) + 1800 * 1000000 <= (SELECT max(epoch_us(assessed_at)) FROM prediction_log) - 600 * 1000000""",
    "prediction_log"))
def stream_session_durations(t):
    out = StreamTable(t.spark, "bursts").append(w.session_durations(predictions(t)))
    return out.select("user_id", micros("session_start", "start_us"), micros("session_end", "end_us"), "n")


@query("dedup_predictions", "SELECT event_id AS conversation_id, epoch_us(ts) AS assessed_us FROM events")
def dedup_predictions(t):
    """Every prediction arrives twice; each is kept once."""
    log = predictions(t)
    twice = log.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = StreamTable(t.spark, "dedup").append(w.dedup_predictions(twice))
    return out.select("conversation_id", micros("assessed_at", "assessed_us"))


@query("stream_upsert_assessments", """
    SELECT user_id AS conversation_id, epoch_us(max(ts)) AS assessed_us, max_by(value, ts) AS value FROM events GROUP BY user_id""")
def stream_upsert_assessments(t):
    """Assessments merged batch by batch, one row per conversation at the end."""
    arrivals = shared_dir(t.spark, "arrivals")
    t.table("events").write.parquet(arrivals)
    rows = stream_folder(t.spark, arrivals, schema=t.table("events").schema, files_per_batch=1).select(
        F.col("user_id").alias("conversation_id"), "value", F.col("ts").alias("assessed_at"))
    table = BucketedTable(t.spark, shared_dir(t.spark, "assessments"), buckets=16)
    StreamTable(t.spark, "upsert").for_each_batch(rows, table.merge)
    return table.read().select(
        "conversation_id", micros("assessed_at", "assessed_us"), "value")


@query("late_rows", over(f"""
    SELECT start_s, count(*) AS n FROM {closed(3600, 86400, "domain <> 'composite'")} GROUP BY 1""", "prediction_log"))
def late_rows(t):
    """Hourly counts in which one kind of event arrives after everything else.

    The second run of the same stream resumes from the first one's checkpoint and drops the
    rows its watermark has passed.
    """
    folder = shared_dir(t.spark, "late")
    events, table = t.table("events"), StreamTable(t.spark, "late-counts")
    late = F.col("event_type") == "error"
    out = None
    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(folder)
        log = prediction_log_of(stream_folder(t.spark, folder, schema=events.schema), domain())
        counted = w.timed(log, delay="1 day").groupBy(F.window("assessed_at", "1 hour")).agg(
            F.count(F.lit(1)).alias("n"))
        out = table.append(counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n"))
    last_on_time = events.filter(~late).select(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    ended = (F.unix_micros(F.col("window_start").cast("timestamp")) + 3600 * 1000000) <= last_on_time - 86400 * 1000000
    return out.filter(ended).select(start_seconds(out), "n")


@query("session_profile_state", over(PROFILE.replace("last_step >= 15 AS completed", "last_step AS last_step").replace(
    "SELECT session, ", "SELECT * EXCLUDE (last_step) FROM (SELECT session, ", 1) + ") WHERE last_step >= 15", "steps"))
def session_profile_state(t):
    """Questionnaire sessions that fill up as answers arrive in several files."""
    folder = shared_dir(t.spark, "answers")
    t.answers.withColumn("part", F.when(F.col("message_id") % 100 < 8, 1).otherwise(2)).write.partitionBy(
        "part").parquet(folder)
    schema, table = t.answers.schema, StreamTable(t.spark, "profiles", timers="processing")
    out = None
    for arrived in ("part=1", "part=[12]"):
        stream = t.spark.readStream.schema(schema).parquet(f"{folder}/{arrived}")
        out = table.append(ss.session_profile_state(stream))
    return ss.typed_profiles(out)


@query("stream_silence_detector", over("""
    SELECT domain, gap_start_us, epoch_us(assessed_at) AS gap_end_us,
           (epoch_us(assessed_at) - gap_start_us) / 1000000.0::DOUBLE AS gap_seconds FROM (
    SELECT domain, assessed_at, epoch_us(lag(assessed_at) OVER (PARTITION BY domain ORDER BY assessed_at)) AS gap_start_us
    FROM prediction_log) WHERE epoch_us(assessed_at) - gap_start_us > 3600 * 1000000::BIGINT""", "prediction_log"))
def stream_silence_detector(t):
    return StreamTable(t.spark, "silence").append(ss.silence_alerts(predictions(t), 3600))


@query("stream_silences", """
    , gaps AS (SELECT user_id, epoch_us(ts) AS last_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS next_us FROM events),
    clock AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600 * 1000000::BIGINT AS watermark_us FROM events)
    SELECT user_id, 'silent' AS kind, last_us AS gap_start_us, NULL::BIGINT AS gap_end_us, 86400.0::DOUBLE AS gap_seconds
    FROM gaps, clock WHERE next_us - last_us > 86400 * 1000000::BIGINT OR (next_us IS NULL AND last_us + 86400 * 1000000::BIGINT <= watermark_us)
    UNION ALL SELECT user_id, 'ended', last_us, next_us, (next_us - last_us) / 1000000.0::DOUBLE
    FROM gaps WHERE next_us - last_us > 86400 * 1000000::BIGINT""".replace(", gaps AS", "WITH gaps AS", 1))
def stream_silences(t):
    """Users without an event for a day: reported when the day is over, also while they stay silent."""
    events = stream_folder(t.spark, t.sf_dir, "events.parquet", t.table("events").schema)
    out = StreamTable(t.spark, "silences", timers="event").append(tm.silences(events, 86400, "user_id", "ts"))
    return out.select(F.col("key").cast("long").alias("user_id"), "kind", "gap_start_us", "gap_end_us", "gap_seconds")


def ended(series: str, seconds: int, where: str = "true") -> str:
    """The buckets of a series that the stream's watermark has closed."""
    return over(f"""SELECT * FROM ({series}) WHERE (bucket + {seconds}) * 1000000::BIGINT <= (
        SELECT max(epoch_us(assessed_at)) // 1000 * 1000 FROM prediction_log WHERE {where}) - 600 * 1000000::BIGINT""", "prediction_log")


def shown_alerts(out):
    return out.select(F.col("key").alias("domain"), "bucket", "n", F.round("baseline", 9).alias("baseline"), "firing", "alert")


@query("stream_volume_drop_alert", ended(alerting(300, 3600, "n < 0.5 * baseline", 600), 300))
def stream_volume_drop_alert(t):
    """Five-minute volume below half its hourly mean for ten minutes, outages included, as time passes."""
    return shown_alerts(StreamTable(t.spark, "volume-drop", timers="event").append(tm.held_alerts(predictions(t), tm.VOLUME_DROP)))


@query("stream_high_stress_surge", ended(alerting(3600, 604800, "n > 1.2 * baseline", 1800, "probability >= 0.5"), 3600, "probability >= 0.5"))
def stream_high_stress_surge(t):
    """Hourly high-stress counts above 1.2 times their weekly mean, as time passes."""
    high = predictions(t).filter(F.col("probability") >= 0.5)
    return shown_alerts(StreamTable(t.spark, "surge", timers="event").append(tm.held_alerts(high, tm.HIGH_STRESS_SURGE)))
