"""Free-text questionnaire answers and result fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import fixed_values as fv

LAKH = r"(?i)([0-9]+\.?[0-9]*)\s*(lakh|l\b)"
THOUSAND = r"(?i)([0-9]+\.?[0-9]*)\s*k\b"
NUMBER = r"[0-9]+\.?[0-9]*"


def parse_amount(text: Column) -> Column:
    """First amount in a text: lakh and k units understood, no number is 0."""
    plain = text
    for noise in (",", "₹", "rupees"):
        plain = F.replace(plain, F.lit(noise), F.lit(""))

    def found(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(plain, pattern, group), F.lit("")).cast("double")

    return F.coalesce(found(LAKH, 1) * 100000, found(THOUSAND, 1) * 1000, found(NUMBER, 0), F.lit(0.0))


def parse_yes(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(fv.YES_WORDS)


def parse_flag(text: Column) -> Column:
    """The narrower yes list of stored profiles."""
    return F.lower(F.trim(text)).isin(fv.FLAG_WORDS)


def parse_region(text: Column) -> Column:
    return F.when(F.lower(text).rlike("urban|city|metro"), "URBAN").otherwise("RURAL")


def parse_hospitalised(text: Column) -> Column:
    answer = F.lower(F.trim(text))
    return answer.contains("hospital") | (answer == "both")


def parse_medication(text: Column) -> Column:
    answer = F.lower(F.trim(text))
    return answer.contains("medication") | answer.contains("medicine") | (answer == "both")


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands between the runs."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def clamp_members(number: Column) -> Column:
    whole = F.floor(F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(1.0)))
    return F.greatest(whole, F.lit(1)).cast("int")


def clamp_age(number: Column) -> Column:
    whole = F.floor(F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(40.0)))
    return F.least(F.greatest(whole, F.lit(18)), F.lit(90)).cast("int")


PROFILE_FIELDS = {
    "state": (1, title_case),
    "num_members": (2, lambda t: clamp_members(parse_amount(t))),
    "region_type": (3, parse_region),
    "monthly_income": (4, parse_amount),
    "monthly_total_expense": (5, parse_amount),
    "monthly_food_expense": (6, parse_amount),
    "monthly_emi": (7, parse_amount),
    "monthly_health_expense": (8, parse_amount),
    "is_hospitalised": (9, parse_hospitalised),
    "is_on_medication": (9, parse_medication),
    "has_health_insurance": (10, parse_yes),
    "has_bank_account": (11, parse_yes),
    "has_life_insurance": (12, parse_yes),
    "occupation": (13, title_case),
    "education": (14, title_case),
    "age_head": (15, lambda t: clamp_age(parse_amount(t))),
}


def answer_steps(messages: DataFrame, session: str = "session", order: str = "message_id") -> DataFrame:
    """Numbers a session's user answers and keeps the questionnaire's 15; later ones are
    ignored, as a completed session ignores them. The bound on the rank lets Spark drop
    further rows of a long session before the shuffle."""
    turn = Window.partitionBy(session).orderBy(order)
    return messages.withColumn("step", F.row_number().over(turn)).filter(
        F.col("step") <= fv.QUESTION_STEPS)


def profile_from_answers(steps: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
    """One typed profile row per session; unanswered fields are null."""
    answers = steps.groupBy(session).agg(*[
        F.max(F.when(F.col("step") == s, F.trim(F.col(text)))).alias(f"a{s}")
        for s in range(1, fv.QUESTION_STEPS + 1)], F.max("step").alias("last_step"))
    return answers.select(
        session,
        *[F.when(F.col(f"a{s}").isNotNull(), parse(F.col(f"a{s}"))).alias(field)
          for field, (s, parse) in PROFILE_FIELDS.items()],
        (F.col("last_step") >= fv.QUESTION_STEPS).alias("completed"))


def risk_band(probability: Column) -> Column:
    return (F.when(probability.isNull(), "N/A").when(probability < 0.3, "Low Risk")
            .when(probability < 0.6, "Moderate").otherwise("High Risk"))


def level_label(level: Column) -> Column:
    names = F.array(*map(F.lit, fv.LEVEL_NAMES))
    return F.element_at(names, F.least(F.coalesce(level, F.lit(0)), F.lit(3)).cast("int") + 1)


def history_flag(financial: Column, food: Column, debt: Column, health: Column) -> Column:
    over = [(financial, 0.5), (food, 0.5), (debt, 0.5), (health, 0.2)]
    flags = [F.coalesce(p > limit, F.lit(False)) for p, limit in over]
    return flags[0] | flags[1] | flags[2] | flags[3]


def household_ratios(income: Column, expense: Column, food: Column, emi: Column) -> dict[str, Column]:
    """Percentages with zero guards, and savings never below zero; all null without income."""
    has_income = F.coalesce(income, F.lit(0.0)) != 0

    def pct(part: Column, whole: Column) -> Column:
        return F.when(has_income, F.try_divide(F.coalesce(part, F.lit(0.0)), whole) * 100)

    return {
        "expense_to_income_pct": pct(expense, income),
        "food_to_expense_pct": pct(food, expense),
        "emi_to_income_pct": pct(emi, income),
        "monthly_savings": F.when(has_income, F.greatest(
            F.lit(0.0), income - F.coalesce(expense, F.lit(0.0)))),
    }


def percent_text(probability: Column) -> Column:
    return (F.when(probability.isNull(), "N/A (health data not collected)")
            .otherwise(F.format_string("%.0f%%", F.bround(probability * 100, 0))))


def advice_rules(df: DataFrame) -> DataFrame:
    """Recommendations for every domain above one half, and the fixed action list."""
    tips = [F.when(F.coalesce(F.col(label), F.lit(0.0)) > 0.5, F.lit(sentence))
            for label, sentence in fv.ADVICE_BY_DOMAIN.items()]
    return df.withColumns({
        "attention": F.array_compact(F.array(*tips)),
        "actions": F.array(*map(F.lit, fv.ADVICE_ACTIONS)),
    })


def step_section(step: Column) -> Column:
    column = None
    for upper, name in fv.STEP_SECTIONS:
        if upper is None:
            return column.otherwise(F.lit(name))
        column = (F.when(step <= upper, name) if column is None else column.when(step <= upper, name))
    return column


def step_funnel(steps: DataFrame, session: str = "session") -> DataFrame:
    """Sessions that reached each step, by section."""
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("sessions")).withColumn(
        "section", step_section(F.col("step")))


def parse_profile_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("parsed", F.from_json(column, schema))


def normalize_email_user(existing: DataFrame, signups: DataFrame) -> DataFrame:
    """Users after sign-ups: an e-mail known already keeps its user, a new one is created
    once, from its first sign-up."""
    first = signups.groupBy("email").agg(F.min_by("name", "signup_id").alias("name"))
    fresh = first.join(existing.select("email"), "email", "left_anti")
    return (existing.select("email", "name", F.lit("existing").alias("status"))
            .unionByName(fresh.withColumn("status", F.lit("created"))))
