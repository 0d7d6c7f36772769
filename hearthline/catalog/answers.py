"""Queries for questionnaire answers and result fields."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import over, text_in
from hearthline.catalog.registry import query
from hearthline.functions import answers as an

PLAIN = "replace(replace(replace(text, ',', ''), '₹', ''), 'rupees', '')"
NUMBER = "[0-9]+\\.?[0-9]*"


def amount(expr: str) -> str:
    plain = PLAIN.replace("text", expr)
    return (f"coalesce(try_cast(nullif(regexp_extract({plain}, '(?i)({NUMBER})\\s*(lakh|l\\b)', 1), '') AS DOUBLE) * 100000, "
            f"try_cast(nullif(regexp_extract({plain}, '(?i)({NUMBER})\\s*k\\b', 1), '') AS DOUBLE) * 1000, "
            f"try_cast(nullif(regexp_extract({plain}, '{NUMBER}'), '') AS DOUBLE), 0)")


def titled(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')")


def yes(expr: str) -> str:
    return f"lower(trim({expr})) IN {text_in(fv.YES_WORDS)}"


@query("parse_amount", over(f"SELECT message_id, {amount('text')} AS amount FROM answers", "answers"))
def parse_amount(t):
    return t.answers.select("message_id", an.parse_amount(F.col("text")).alias("amount"))


@query("parse_yes", over(f"""
    SELECT message_id, {yes('text')} AS yes, lower(trim(text)) IN {text_in(fv.FLAG_WORDS)} AS flag FROM answers""",
    "answers"))
def parse_yes(t):
    return t.answers.select("message_id", an.parse_yes(F.col("text")).alias("yes"),
                            an.parse_flag(F.col("text")).alias("flag"))


@query("parse_region", over("""
    SELECT message_id, CASE WHEN regexp_matches(lower(text), 'urban|city|metro') THEN 'URBAN' ELSE 'RURAL' END AS region
    FROM answers""", "answers"))
def parse_region(t):
    return t.answers.select("message_id", an.parse_region(F.col("text")).alias("region"))


@query("parse_health_answer", over("""
    SELECT message_id, contains(lower(text), 'hospital') OR lower(trim(text)) = 'both' AS hospitalised,
           contains(lower(text), 'medication') OR contains(lower(text), 'medicine') OR lower(trim(text)) = 'both'
           AS medication FROM answers""", "answers"))
def parse_health_answer(t):
    return t.answers.select("message_id", an.parse_hospitalised(F.col("text")).alias("hospitalised"),
                            an.parse_medication(F.col("text")).alias("medication"))


@query("title_case", over(f"SELECT message_id, {titled('text')} AS titled FROM answers", "answers"))
def title_case(t):
    return t.answers.select("message_id", an.title_case(F.col("text")).alias("titled"))


@query("clamp_household", over(f"""
    SELECT message_id, cast(greatest(floor(coalesce(nullif(a, 0), 1)), 1) AS INTEGER) AS members,
           cast(least(greatest(floor(coalesce(nullif(a, 0), 40)), 18), 90) AS INTEGER) AS age
    FROM (SELECT message_id, {amount('text')} AS a FROM answers)""", "answers"))
def clamp_household(t):
    number = an.parse_amount(F.col("text"))
    return t.answers.select("message_id", an.clamp_members(number).alias("members"), an.clamp_age(number).alias("age"))


def answer(step: int) -> str:
    return f"max(CASE WHEN step = {step} THEN trim(text) END)"


PROFILE = f"""
    SELECT session, {titled('a1')} AS state, cast(greatest(floor(coalesce(nullif({amount('a2')}, 0), 1)), 1) AS INTEGER) AS num_members,
           CASE WHEN regexp_matches(lower(a3), 'urban|city|metro') THEN 'URBAN' ELSE 'RURAL' END AS region_type,
           {amount('a4')} AS monthly_income, {amount('a5')} AS monthly_total_expense,
           {amount('a6')} AS monthly_food_expense, {amount('a7')} AS monthly_emi, {amount('a8')} AS monthly_health_expense,
           contains(lower(a9), 'hospital') OR lower(a9) = 'both' AS is_hospitalised,
           contains(lower(a9), 'medication') OR contains(lower(a9), 'medicine') OR lower(a9) = 'both' AS is_on_medication,
           {yes('a10')} AS has_health_insurance, {yes('a11')} AS has_bank_account, {yes('a12')} AS has_life_insurance,
           {titled('a13')} AS occupation, {titled('a14')} AS education,
           CASE WHEN a15 IS NOT NULL THEN cast(least(greatest(floor(coalesce(nullif({amount('a15')}, 0), 40)), 18), 90) AS INTEGER) END AS age_head,
           last_step >= 15 AS completed
    FROM (SELECT session, max(step) AS last_step, {", ".join(f"{answer(s)} AS a{s}" for s in range(1, 16))}
          FROM steps GROUP BY session)"""


@query("profile_from_answers", over(PROFILE, "steps"))
def profile_from_answers(t):
    return an.profile_from_answers(an.answer_steps(t.answers))


@query("risk_band", over("""
    SELECT conversation_id, CASE WHEN health_stress_prob IS NULL THEN 'N/A' WHEN health_stress_prob < 0.3 THEN 'Low Risk'
           WHEN health_stress_prob < 0.6 THEN 'Moderate' ELSE 'High Risk' END AS band FROM assessments""", "assessments"))
def risk_band(t):
    return t.assessments.select("conversation_id", an.risk_band(F.col("health_stress_prob")).alias("band"))


@query("level_label", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot,
           list_extract(['None', 'Mild', 'Moderate', 'Severe'], least(composite_stress_score, 3) + 1) AS level
    FROM household""", "household"))
def level_label(t):
    return t.household.select("household_id", F.col("month_slot").cast("string").alias("month_slot"),
                              an.level_label(F.col("composite_stress_score")).alias("level"))


@query("history_flag", over("""
    SELECT conversation_id, coalesce(financial_stress_prob > 0.5, false) OR coalesce(food_stress_prob > 0.5, false)
        OR coalesce(debt_stress_prob > 0.5, false) OR coalesce(health_stress_prob > 0.2, false) AS stressed
    FROM assessments""", "assessments"))
def history_flag(t):
    return t.assessments.select("conversation_id", an.history_flag(
        F.col("financial_stress_prob"), F.col("food_stress_prob"), F.col("debt_stress_prob"),
        F.col("health_stress_prob")).alias("stressed"))


@query("household_ratios", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot,
           CASE WHEN inc <> 0 THEN ex / inc * 100 END AS expense_to_income_pct,
           CASE WHEN inc <> 0 AND ex <> 0 THEN coalesce(monthly_food_expense, 0) / ex * 100 END AS food_to_expense_pct,
           CASE WHEN inc <> 0 THEN coalesce(monthly_emi, 0) / inc * 100 END AS emi_to_income_pct,
           CASE WHEN inc <> 0 THEN greatest(0.0, inc - coalesce(ex, 0)) END AS monthly_savings
    FROM (SELECT *, monthly_income AS inc, monthly_total_expense AS ex FROM profiles)""", "profiles"))
def household_ratios(t):
    ratios = an.household_ratios(F.col("monthly_income"), F.col("monthly_total_expense"),
                                 F.col("monthly_food_expense"), F.col("monthly_emi"))
    return t.profiles.select("household_id", F.col("month_slot").cast("string").alias("month_slot"),
                             *[c.alias(n) for n, c in ratios.items()])


ADVICE = list(fv.ADVICE_BY_DOMAIN.values())


@query("advice_rules", over(f"""
    SELECT conversation_id, array_to_string(list_filter([
        CASE WHEN financial_stress_prob > 0.5 THEN '{ADVICE[0]}' END, CASE WHEN food_stress_prob > 0.5 THEN '{ADVICE[1]}' END,
        CASE WHEN debt_stress_prob > 0.5 THEN '{ADVICE[2]}' END, CASE WHEN health_stress_prob > 0.5 THEN '{ADVICE[3]}' END],
        lambda x: x IS NOT NULL), '|') AS attention, {len(fv.ADVICE_ACTIONS)} AS n_actions FROM assessments""", "assessments"))
def advice_rules(t):
    named = t.assessments.select("conversation_id", *[
        F.col(f"{label}_prob").alias(label) for label in fv.STRESS_LABELS])
    return an.advice_rules(named).select("conversation_id", F.array_join("attention", "|").alias("attention"),
                                         F.size("actions").alias("n_actions"))


@query("step_section", over("""
    SELECT step, count(*) AS sessions, CASE WHEN step <= 1 THEN 'Location' WHEN step <= 3 THEN 'Household Info'
           WHEN step <= 8 THEN 'Income & Expenses' WHEN step <= 12 THEN 'Health & Insurance' ELSE 'Final Details' END
           AS section FROM steps GROUP BY step""", "steps"))
def step_section(t):
    return an.step_funnel(an.answer_steps(t.answers))


@query("parse_profile_json", """
    SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def parse_profile_json(t):
    return an.parse_profile_json(t.table("events"), "props", "k int").select("event_id", F.col("parsed.k").alias("k"))


@query("normalize_email_user", """
    SELECT 'user' || c_custkey || '@example.org' AS email, c_name AS name, 'existing' AS status FROM customer
    UNION ALL
    SELECT email, arg_min(name, signup_id), 'created' FROM (
    SELECT 'user' || (o_custkey * 2) || '@example.org' AS email, 'Order ' || o_orderkey AS name, o_orderkey AS signup_id
    FROM orders) WHERE email NOT IN (SELECT 'user' || c_custkey || '@example.org' FROM customer) GROUP BY email""")
def normalize_email_user(t):
    def email(key):
        return F.concat(F.lit("user"), key.cast("string"), F.lit("@example.org")).alias("email")

    existing = t.table("customer").select(email(F.col("c_custkey")), F.col("c_name").alias("name"))
    signups = t.table("orders").select(
        email(F.col("o_custkey") * 2), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("signup_id"))
    return an.normalize_email_user(existing, signups)
