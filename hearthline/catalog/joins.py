"""Queries for joins, set operations and reads over the assessment store."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import over, text_list
from hearthline.catalog.registry import micros, query, rounded, text
from hearthline.operators import assessments as a
from hearthline.operators import joins as j
from hearthline.operators.profile import feature_bounds
from hearthline.sources.raw import union_months
from hearthline.sources.sinks import upsert_assessments

AS_OF = "2024-01-31 00:00:00"


@query("join_income_consumption", over(f"""
    SELECT inc.household_id, cast(inc.month_slot AS VARCHAR) AS month_slot, inc.reference_month, total_income,
           total_expenditure_adjusted, exp_food_adjusted
    FROM inc JOIN con ON {" AND ".join(f"inc.{k} IS NOT DISTINCT FROM con.{k}" for k in ["file_stamp", *fv.MONTHLY_KEYS])}""",
    "inc", "con"))
def join_income_consumption(t):
    return j.join_income_consumption(t.inc, t.con).select(
        "household_id", text("month_slot"), "reference_month", "total_income", "total_expenditure_adjusted",
        "exp_food_adjusted")


@query("join_people", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, reference_month,
           is_hospitalised_hh_any, has_bank_account_hh_any, round(age_years_hh_mean, 6) AS age_years_hh_mean,
           education_rank_hh_max, gender_hh_mode FROM joined""", "joined"))
def join_people(t):
    joined = j.join_people(j.join_income_consumption(t.inc, t.con), t.people)
    return joined.select(
        "household_id", text("month_slot"), "reference_month", "is_hospitalised_hh_any",
        "has_bank_account_hh_any", rounded("age_years_hh_mean"), "education_rank_hh_max", "gender_hh_mode")


@query("match_month_pairs", over("""
    SELECT file_stamp FROM inc INTERSECT SELECT file_stamp FROM con""", "inc", "con"))
def match_month_pairs(t):
    return j.match_month_pairs(t.inc, t.con)


@query("user_assessments", over("""
    SELECT a.conversation_id, c.user_id, epoch_us(a.assessed_at) AS assessed_us, a.financial_stress_prob
    FROM assessments a JOIN chats c USING (conversation_id) WHERE c.user_id IS NOT NULL""",
    "assessments", "chats"))
def user_assessments(t):
    return j.user_assessments(t.assessments, t.chats).select(
        "conversation_id", "user_id", micros("assessed_at", "assessed_us"), "financial_stress_prob")


@query("assessments_with_session", over("""
    SELECT a.conversation_id, c.session_id, epoch_us(a.assessed_at) AS assessed_us, a.prediction_confidence
    FROM assessments a LEFT JOIN chats c USING (conversation_id)
    WHERE a.prediction_confidence IS NOT NULL
    ORDER BY a.assessed_at DESC, a.conversation_id DESC LIMIT 50""", "assessments", "chats"))
def assessments_with_session(t):
    return j.assessments_with_session(t.assessments, t.chats).select(
        "conversation_id", "session_id", micros("assessed_at", "assessed_us"), "prediction_confidence")


PRIOR_VALUES = ", ".join(f"('{s}', {p})" for s, p in fv.STATE_PRIORS.items())


@query("state_prior_lookup", over(f"""
    SELECT HH_ID, STATE, cast(coalesce(prior, 0.42) AS DOUBLE) AS state_prior
    FROM keys LEFT JOIN (VALUES {PRIOR_VALUES}) AS p(state_name, prior) ON STATE = state_name""", "keys"))
def state_prior_lookup(t):
    return j.state_prior_lookup(t.keys, "STATE").select("HH_ID", "STATE", "state_prior")


BOUNDED = ["savings_proxy", "emi_to_income_ratio", "exp_food_adjusted"]


@query("bounds_check_join", over(f"""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, feature, value, round(p1, 6) AS p1, round(p99, 6) AS p99
    FROM (SELECT household_id, month_slot, unnest({text_list(BOUNDED)}) AS feature,
                 unnest([{", ".join(BOUNDED)}]) AS value FROM household)
    JOIN ({" UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, 0.01) AS p1, quantile_cont({f}, 0.99) AS p99 FROM household" for f in BOUNDED)})
    USING (feature) WHERE value < p1 OR value > p99""", "household"))
def bounds_check_join(t):
    found = j.bounds_check(t.household, feature_bounds(t.household, BOUNDED),
                           ["household_id", "month_slot"], BOUNDED)
    return found.select("household_id", text("month_slot"), "feature", "value", rounded("p1"), rounded("p99"))


@query("orphan_keys", over("""
    SELECT DISTINCT household_id, cast(month_slot AS VARCHAR) AS month_slot FROM con
    WHERE (household_id, month_slot) NOT IN (SELECT household_id, month_slot FROM inc)""", "inc", "con"))
def orphan_keys(t):
    return j.orphan_keys(t.con, t.inc, ["household_id", "month_slot"]).select("household_id", text("month_slot"))


@query("union_months", over("""
    SELECT household_id, reference_month, total_income, NULL::DOUBLE AS exp_food_adjusted FROM inc
    UNION ALL SELECT household_id, reference_month, NULL::DOUBLE, exp_food_adjusted FROM con""", "inc", "con"))
def union(t):
    return union_months([t.inc.select("household_id", "reference_month", "total_income"),
                         t.con.select("household_id", "reference_month", "exp_food_adjusted")])


@query("intersect_months", over("""
    SELECT reference_month FROM inc INTERSECT SELECT reference_month FROM con""", "inc", "con"))
def intersect_months(t):
    return t.inc.select("reference_month").intersect(t.con.select("reference_month"))


@query("missing_in_other", over("""
    SELECT household_id, reference_month FROM con EXCEPT ALL
    SELECT household_id, reference_month FROM inc""", "inc", "con"))
def missing_in_other(t):
    return t.con.select("household_id", "reference_month").exceptAll(
        t.inc.select("household_id", "reference_month"))


@query("read_recent_assessments", over(f"""
    SELECT conversation_id, epoch_us(assessed_at) AS assessed_us, is_stressed FROM assessments
    WHERE assessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""", "assessments"))
def read_recent_assessments(t):
    return a.read_recent_assessments(t.assessments, AS_OF).select(
        "conversation_id", micros("assessed_at", "assessed_us"), "is_stressed")


LATEST = """
    SELECT user_id AS conversation_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id,
           epoch_us(max(ts)) AS assessed_us FROM events GROUP BY user_id"""


@query("latest_per_conversation", LATEST)
def latest_per_conversation(t):
    events = t.table("events").select(F.col("user_id").alias("conversation_id"), "event_id",
                                      F.col("ts").alias("assessed_at"))
    return a.latest_per_conversation(events, order=["assessed_at", "event_id"]).select(
        "conversation_id", "event_id", micros("assessed_at", "assessed_us"))


@query("upsert_assessments", """
    SELECT user_id AS conversation_id, round(max_by(value, ts), 6) AS value, epoch_us(max(ts)) AS assessed_us
    FROM events GROUP BY user_id""")
def upsert(t):
    rows = t.table("events").select(F.col("user_id").alias("conversation_id"), "value",
                                    F.col("ts").alias("assessed_at"))
    existing = rows.filter(F.col("assessed_at") < F.lit("2024-01-16").cast("timestamp_ntz"))
    incoming = rows.filter(F.col("assessed_at") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    stored = a.latest_per_conversation(existing)
    return upsert_assessments(stored, incoming).select(
        "conversation_id", rounded("value"), micros("assessed_at", "assessed_us"))


@query("recent_history", over("""
    SELECT conversation_id, epoch_us(assessed_at) AS assessed_us, prediction_confidence FROM assessments
    WHERE prediction_confidence IS NOT NULL ORDER BY assessed_at DESC, conversation_id DESC LIMIT 50""",
    "assessments"))
def recent_history(t):
    return a.recent_history(t.assessments).select(
        "conversation_id", micros("assessed_at", "assessed_us"), "prediction_confidence")


@query("stress_rate", over(f"""
    SELECT round(coalesce(avg(CASE WHEN is_stressed THEN 1.0 ELSE 0.0 END), 0.42), 6) AS stress_rate
    FROM assessments WHERE assessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""", "assessments"))
def stress_rate(t):
    return a.stress_rate(t.assessments, AS_OF).select(rounded("stress_rate"))


@query("mean_confidence", over("""
    SELECT conversation_id, round(list_avg([financial_stress_prob, food_stress_prob, health_stress_prob]), 9)
           AS mean_confidence FROM assessments""", "assessments"))
def mean_confidence(t):
    stds = F.array("financial_stress_prob", "food_stress_prob", "health_stress_prob")
    return t.assessments.select("conversation_id", F.round(a.mean_confidence(stds), 9).alias("mean_confidence"))


@query("transcript", """
    SELECT conv_id, turn, role, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS preview
    FROM conversations""")
def transcript(t):
    return a.transcript(t.table("conversations")).select("conv_id", "turn", "role", "preview")


@query("ab_summary", over("""
    SELECT model_version, ab_group, count(*) AS n, count(*) FILTER (WHERE is_stressed) AS stressed,
           round(avg(financial_stress_prob), 6) AS mean_financial
    FROM assessments GROUP BY model_version, ab_group""", "assessments"))
def ab_summary(t):
    return a.ab_summary(t.assessments).withColumn("mean_financial", F.round("mean_financial", 6))


@query("session_durations", """
    SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS messages,
           (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events GROUP BY user_id""")
def session_durations(t):
    return a.conversation_durations(t.table("events"), "user_id", "ts").select(
        "user_id", micros("started_at", "started_us"), micros("ended_at", "ended_us"), "messages", "seconds")


@query("completed_share_per_day", over("""
    SELECT cast(cast(started_at AS DATE) AS VARCHAR) AS day, count(*) AS conversations,
           round(avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END), 6) AS completed_share
    FROM chats GROUP BY 1""", "chats"))
def completed_share_per_day(t):
    return a.completed_share_per_day(t.chats).select(text("day"), "conversations", rounded("completed_share"))
