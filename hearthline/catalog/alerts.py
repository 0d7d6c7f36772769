"""Queries for rates over time, sustained conditions and gaps."""

from pyspark.sql import functions as F

from hearthline.catalog.oracle_views import over
from hearthline.catalog.registry import query, rounded
from hearthline.operators import alerts as al


def buckets(seconds: int, where: str = "true") -> str:
    return (f"(SELECT domain, cast(floor(epoch_us(assessed_at) / 1000000) AS BIGINT) // {seconds} * {seconds} AS bucket, "
            f"count(*) AS n FROM prediction_log WHERE {where} GROUP BY 1, 2)")


def based(seconds: int, span: int, where: str = "true") -> str:
    return (f"(SELECT *, avg(n) OVER (PARTITION BY domain ORDER BY bucket "
            f"RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS baseline FROM {buckets(seconds, where)})")


def filled(seconds: int, where: str = "true") -> str:
    """Counts with zeros from a domain's first bucket to the last one of all."""
    return (f"(WITH c AS {buckets(seconds, where)} SELECT e.domain, e.bucket, coalesce(c.n, 0) AS n FROM ("
            f"SELECT domain, unnest(generate_series(min(bucket), (SELECT max(bucket) FROM c), {seconds})) AS bucket "
            f"FROM c GROUP BY domain) e LEFT JOIN c ON c.domain = e.domain AND c.bucket = e.bucket)")


def alerting(seconds: int, span: int, firing: str, hold: int, where: str = "true") -> str:
    """Firing buckets, and those whose last `hold` seconds fired throughout."""
    fired = (f"(SELECT *, {firing} AS firing FROM (SELECT *, avg(n) OVER (PARTITION BY domain ORDER BY bucket "
             f"RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS baseline FROM {filled(seconds, where)}))")
    return (f"SELECT domain, bucket, n, round(baseline, 9) AS baseline, firing, firing AND bucket - min(bucket) OVER "
            f"(PARTITION BY domain, firing, island) >= {hold} AS alert FROM (SELECT *, bucket - {seconds} * row_number() "
            f"OVER (PARTITION BY domain, firing ORDER BY bucket) AS island FROM {fired})")


@query("prediction_counts", over(f"SELECT * FROM {buckets(300)}", "prediction_log"))
def prediction_counts(t):
    return al.bucket_counts(t.prediction_log, 5 * al.MINUTE)


@query("rolling_baseline", over(f"""
    SELECT domain, bucket, n, round(baseline, 9) AS baseline FROM {based(3600, 604800)}""", "prediction_log"))
def rolling_baseline(t):
    counts = al.bucket_counts(t.prediction_log, al.HOUR)
    return al.rolling_baseline(counts, al.WEEK).withColumn("baseline", F.round("baseline", 9))


@query("volume_drop_alert", over(alerting(300, 3600, "n < 0.5 * baseline", 600), "prediction_log"))
def volume_drop_alert(t):
    return al.volume_drop_alert(t.prediction_log).withColumn("baseline", F.round("baseline", 9))


@query("high_stress_surge", over(alerting(3600, 604800, "n > 1.2 * baseline", 1800, "probability >= 0.5"), "prediction_log"))
def high_stress_surge(t):
    return al.high_stress_surge(t.prediction_log).withColumn("baseline", F.round("baseline", 9))


@query("domain_surge", over(alerting(3600, 604800, "n > 1.3 * baseline", 3600,
                            "probability >= 0.5 AND domain = 'financial_stress'"), "prediction_log"))
def domain_surge(t):
    return al.domain_surge(t.prediction_log).withColumn("baseline", F.round("baseline", 9))


@query("latency_p99_alert", over("""
    SELECT bucket, round(p99, 9) AS p99, CASE WHEN p99 > 2 THEN 'critical' WHEN p99 > 0.5 THEN 'warning' ELSE 'ok' END
           AS severity FROM (
    SELECT cast(floor(epoch_us(assessed_at) / 1000000) AS BIGINT) // 300 * 300 AS bucket,
           quantile_cont(latency, 0.99) AS p99 FROM prediction_log GROUP BY 1)""", "prediction_log"))
def latency_p99_alert(t):
    return al.latency_p99_alert(t.prediction_log).select("bucket", rounded("p99", 9), "severity")


@query("sustained_condition", over(f"""
    SELECT domain, min(bucket) AS run_start, max(bucket) + 3600 AS run_end, count(*) AS buckets FROM (
    SELECT *, bucket - row_number() OVER (PARTITION BY domain ORDER BY bucket) * 3600 AS island
    FROM {based(3600, 604800)} WHERE n > 1.2 * baseline)
    GROUP BY domain, island HAVING max(bucket) + 3600 - min(bucket) >= 7200""", "prediction_log"))
def sustained_condition(t):
    series = al.surge(al.bucket_counts(t.prediction_log, al.HOUR), al.WEEK, 1.2)
    return al.sustained_condition(series, al.HOUR, 2 * al.HOUR)


@query("silence_detector", """
    SELECT user_id, gap_start_us, epoch_us(ts) AS gap_end_us,
           (epoch_us(ts) - gap_start_us) / 1000000.0::DOUBLE AS gap_seconds FROM (
    SELECT user_id, ts, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap_start_us FROM events)
    WHERE epoch_us(ts) - gap_start_us > 86400 * 1000000::BIGINT""")
def silence_detector(t):
    return al.silence_detector(t.table("events"), ["user_id"], 86400, ts="ts")


@query("silence_by_domain", over("""
    SELECT domain, gap_start_us, epoch_us(assessed_at) AS gap_end_us,
           (epoch_us(assessed_at) - gap_start_us) / 1000000.0::DOUBLE AS gap_seconds FROM (
    SELECT domain, assessed_at, epoch_us(lag(assessed_at) OVER (PARTITION BY domain ORDER BY assessed_at)) AS gap_start_us
    FROM prediction_log) WHERE epoch_us(assessed_at) - gap_start_us > 3600 * 1000000::BIGINT""", "prediction_log"))
def silence_by_domain(t):
    return al.silence_detector(t.prediction_log, ["domain"], al.HOUR)
