"""Queries for drift and retraining. Baseline: months before the demo cutoff."""

from pyspark.sql import functions as F

from hearthline.catalog.oracle_views import over
from hearthline.catalog.registry import query, rounded
from hearthline.catalog.survey_views import DEMO_CUTOFF
from hearthline.operators.assessments import stress_rate
from hearthline.operators.order_stats import long_form
from hearthline.operators.sketches import GRID, RANK_ERROR, SketchStore, sketch_drift, sketch_quantiles
from hearthline.plans import drift as d
from hearthline.session import cut_lineage, shared_dir

NUMERIC = ["savings_proxy", "food_to_expense_ratio", "exp_food_adjusted", "age_years_hh_mean"]
CATEGORICAL = ["state", "region_type", "occupation_group", "education_group"]
SIDES = f"(SELECT *, CASE WHEN month_slot < DATE '{DEMO_CUTOFF}' THEN 1 ELSE 0 END AS b FROM household)"
AS_OF = "2024-01-31 00:00:00"


def written(t, columns):
    """The columns of all household months, computed once for the passes over them."""
    return cut_lineage(t.household.select("month_slot", *columns))


def sides_of(months):
    edge = F.lit(DEMO_CUTOFF).cast("date")
    return months.filter(F.col("month_slot") < edge), months.filter(F.col("month_slot") >= edge)


def sides(t, columns):
    return sides_of(written(t, columns))


def _ks(c: str) -> str:
    steps = f"""(SELECT {c} AS v, sum(sum(b)) OVER (ORDER BY {c}) / sum(sum(b)) OVER ()::DOUBLE AS f1,
                 sum(sum(1 - b)) OVER (ORDER BY {c}) / sum(sum(1 - b)) OVER ()::DOUBLE AS f2,
                 lead({c}) OVER (ORDER BY {c}) AS nxt FROM {SIDES} WHERE {c} IS NOT NULL GROUP BY {c})"""
    spread = f"(SELECT greatest(stddev_pop({c}), 0.001) FROM {SIDES} WHERE b = 1)"
    deciles = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10))
    bins = f"""(SELECT greatest(sum(b)::DOUBLE / sum(sum(b)) OVER (), 0.0001) AS p,
                       greatest(sum(1 - b)::DOUBLE / sum(sum(1 - b)) OVER (), 0.0001) AS q
                FROM (SELECT b, len(list_filter(edges, lambda e: e < {c})) AS bin FROM {SIDES},
                      (SELECT [{deciles}] AS edges FROM {SIDES} WHERE b = 1) WHERE {c} IS NOT NULL) GROUP BY bin)"""
    lam = "(sqrt(n_base * n_cur / (n_base + n_cur)) + 0.12 + 0.11 / sqrt(n_base * n_cur / (n_base + n_cur))) * d"
    p_value = (f"CASE WHEN {lam} < 0.2 THEN 1 ELSE 2 * list_sum(list_transform(range(1, 31), "
               f"lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * pow({lam}, 2)))) END")
    return f"""SELECT '{c}' AS feature, round(d, 6) AS ks, round(w, 6) AS wasserstein,
                      (SELECT round(sum((q - p) * ln(q / p)), 6) FROM {bins}) AS psi, n_base::BIGINT AS n_base,
                      w >= 0.1 AS drifted, {p_value} < 0.05 AS drifted_by_ks
               FROM (SELECT max(abs(f1 - f2)) AS d, sum(abs(f1 - f2) * (nxt - v)) / {spread} AS w FROM {steps}),
                    (SELECT (count({c}) FILTER (WHERE b = 1))::DOUBLE AS n_base,
                            (count({c}) FILTER (WHERE b = 0))::DOUBLE AS n_cur FROM {SIDES})"""


@query("numeric_drift", over(" UNION ALL ".join(_ks(c) for c in NUMERIC), "household"))
def numeric_drift(t):
    return d.numeric_drift(*sides(t, NUMERIC), NUMERIC).select(
        "feature", rounded("ks"), rounded("wasserstein"), rounded("psi"), "n_base", "drifted",
        (F.col("ks_p_value") < d.P_VALUE_LIMIT).alias("drifted_by_ks"))


def _js(c: str) -> str:
    return f"""SELECT '{c}' AS feature, count(*) AS levels, round(sqrt(greatest(sum(
        (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
         + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 6) AS js_distance,
        round(sum(CASE WHEN p > 0 THEN (cur - n * p) * (cur - n * p) / (n * p) END), 4) AS chi_square
        FROM (SELECT sum(b)::DOUBLE / sum(sum(b)) OVER () AS p, sum(1 - b)::DOUBLE / sum(sum(1 - b)) OVER () AS q,
              sum(1 - b)::DOUBLE AS cur, (sum(sum(1 - b)) OVER ())::DOUBLE AS n
              FROM {SIDES} WHERE {c} IS NOT NULL GROUP BY {c})"""


@query("categorical_drift", over(" UNION ALL ".join(_js(c) for c in CATEGORICAL), "household"))
def categorical_drift(t):
    return d.categorical_drift(*sides(t, CATEGORICAL), CATEGORICAL).select(
        "feature", "levels", rounded("js_distance"), rounded("chi_square", 4))


MISSING = ["total_income", "exp_education", "exp_vacation", "age_group", "occupation_group"]


@query("missing_drift", over(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(bm * 100.0::DOUBLE / bn, 6) AS baseline_pct,
        round(cm * 100.0::DOUBLE / cn, 6) AS current_pct FROM (
        SELECT count(*) FILTER (WHERE b = 1) AS bn, count(*) FILTER (WHERE b = 1 AND {c} IS NULL) AS bm,
               count(*) FILTER (WHERE b = 0) AS cn, count(*) FILTER (WHERE b = 0 AND {c} IS NULL) AS cm FROM {SIDES})"""
    for c in MISSING), "household"))
def missing_drift(t):
    return d.missing_drift(*sides(t, MISSING), MISSING).select(
        "column_name", rounded("baseline_pct"), rounded("current_pct"))


@query("drift_share", over(f"""
    SELECT count(*) AS columns, count(*) FILTER (WHERE drifted) AS drifted_columns,
           round(avg(drifted::INTEGER), 9) AS drift_share, avg(drifted::INTEGER) > 0.3 AS alert FROM (
    SELECT feature, drifted FROM ({" UNION ALL ".join(_ks(c) for c in NUMERIC)}) UNION ALL
    SELECT feature, js_distance >= 0.1 FROM ({" UNION ALL ".join(_js(c) for c in CATEGORICAL)}))""", "household"))
def drift_share(t):
    before, after = sides(t, [*NUMERIC, *CATEGORICAL])
    return d.drift_share(d.numeric_drift(before, after, NUMERIC),
                         d.categorical_drift(before, after, CATEGORICAL)).withColumn(
        "drift_share", F.round("drift_share", 9))


@query("retrain_decision", over(f"""
    SELECT round(drift_share, 6) AS drift_share, round(stress_rate, 6) AS stress_rate,
           concat_ws('; ', CASE WHEN drift_share > 0.30 THEN 'dataset drift ' || printf('%.2f', drift_share * 100) || '% > 30%' END,
               CASE WHEN abs(stress_rate - 0.42) > 0.15 THEN 'stress rate shift ' || printf('%.2f', abs(stress_rate - 0.42) * 100) || '% > 15%' END) AS reasons,
           drift_share > 0.30 OR abs(stress_rate - 0.42) > 0.15 AS retrain FROM
    (SELECT avg((js_distance >= 0.1)::INTEGER) AS drift_share FROM ({" UNION ALL ".join(_js(c) for c in CATEGORICAL)})),
    (SELECT avg(CASE WHEN is_stressed THEN 1.0::DOUBLE ELSE 0 END) AS stress_rate FROM assessments
     WHERE assessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""", "household", "assessments"))
def retrain_decision(t):
    share = d.drift_share(d.categorical_drift(*sides(t, CATEGORICAL), CATEGORICAL))
    return d.retrain_decision(share, stress_rate(t.assessments, AS_OF)).select(
        rounded("drift_share"), rounded("stress_rate"), "reasons", "retrain")


#: All columns of the reference monitor, and those above.
MONITORED = list(dict.fromkeys([*NUMERIC, "income_all_members_from_wages", "emi_to_income_ratio", "health_to_expense_ratio"]))
ALL_SHARE = f"""SELECT feature, drifted FROM ({" UNION ALL ".join(_ks(c) for c in MONITORED)}) UNION ALL
    SELECT feature, js_distance >= 0.1 FROM ({" UNION ALL ".join(_js(c) for c in CATEGORICAL)})"""


@query("monitored_numeric_drift", over(" UNION ALL ".join(_ks(c) for c in MONITORED), "household"))
def monitored_numeric_drift(t):
    return d.numeric_drift(*sides(t, MONITORED), MONITORED).select(
        "feature", rounded("ks"), rounded("wasserstein"), rounded("psi"), "n_base", "drifted",
        (F.col("ks_p_value") < d.P_VALUE_LIMIT).alias("drifted_by_ks"))


def monitored_share(t):
    before, after = sides(t, [*MONITORED, *CATEGORICAL])
    return d.drift_share(d.numeric_drift(before, after, MONITORED), d.categorical_drift(before, after, CATEGORICAL))


@query("monitored_drift_share", over(f"""
    SELECT count(*) AS columns, count(*) FILTER (WHERE drifted) AS drifted_columns,
           round(avg(drifted::INTEGER), 9) AS drift_share, avg(drifted::INTEGER) > 0.3 AS alert FROM ({ALL_SHARE})""", "household"))
def monitored_drift_share(t):
    return monitored_share(t).withColumn("drift_share", F.round("drift_share", 9))


@query("monitored_retrain_decision", over(f"""
    SELECT round(drift_share, 6) AS drift_share, round(stress_rate, 6) AS stress_rate,
           concat_ws('; ', CASE WHEN drift_share > 0.30 THEN 'dataset drift ' || printf('%.2f', drift_share * 100) || '% > 30%' END,
               CASE WHEN abs(stress_rate - 0.42) > 0.15 THEN 'stress rate shift ' || printf('%.2f', abs(stress_rate - 0.42) * 100) || '% > 15%' END) AS reasons,
           drift_share > 0.30 OR abs(stress_rate - 0.42) > 0.15 AS retrain FROM
    (SELECT avg(drifted::INTEGER) AS drift_share FROM ({ALL_SHARE})),
    (SELECT avg(CASE WHEN is_stressed THEN 1.0::DOUBLE ELSE 0 END) AS stress_rate FROM assessments
     WHERE assessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""", "household", "assessments"))
def monitored_retrain_decision(t):
    return d.retrain_decision(monitored_share(t), stress_rate(t.assessments, AS_OF)).select(
        rounded("drift_share"), rounded("stress_rate"), "reasons", "retrain")


PREDICTED = ["financial_stress", "food_stress", "debt_stress", "health_stress", "composite_stress_score"]


@query("prediction_drift", over(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE b = 1), 6) AS baseline_mean,
        round(avg({c}) FILTER (WHERE b = 0), 6) AS current_mean,
        abs(avg({c}) FILTER (WHERE b = 0) - avg({c}) FILTER (WHERE b = 1)) > 0.15 AS alert FROM {SIDES}"""
    for c in PREDICTED), "household"))
def prediction_drift(t):
    return d.prediction_drift(*sides(t, PREDICTED), PREDICTED).select(
        "feature", rounded("baseline_mean"), rounded("current_mean"), "alert")


@query("baseline_rows", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, financial_stress, savings_proxy FROM household
    WHERE financial_stress IS NOT NULL""", "household"))
def baseline_rows(t):
    return d.baseline_rows(t.household).select(
        "household_id", F.col("month_slot").cast("string").alias("month_slot"), "financial_stress", "savings_proxy")


@query("align_columns", over("""
    SELECT 'baseline' AS side, financial_stress::DOUBLE AS financial_stress, food_stress::DOUBLE AS food_stress, household_id FROM household
    UNION ALL SELECT 'current', financial_stress_prob, food_stress_prob, cast(conversation_id AS VARCHAR) FROM assessments""",
    "household", "assessments"))
def align_columns(t):
    """Both sides on the columns they share, the baseline's order first."""
    current = t.assessments.select(
        F.col("conversation_id").cast("string").alias("household_id"), F.lit("extra").alias("only_here"),
        F.col("financial_stress_prob").alias("financial_stress"), F.col("food_stress_prob").alias("food_stress"))
    before = t.household.select(F.col("financial_stress").cast("double").alias("financial_stress"),
                                F.col("food_stress").cast("double").alias("food_stress"), "household_id", "state")
    aligned = zip(("baseline", "current"), d.align_columns(before, current))
    one, other = [df.select(F.lit(side).alias("side"), *df.columns) for side, df in aligned]
    return one.union(other)


def stored_sketches(t, months):
    """The survey's months sketched one side after the other, as they would arrive."""
    store = SketchStore(t.spark, shared_dir(t.spark, "sketches"))
    for part in sides_of(months):
        store.add(part, MONITORED)
    return store


@query("sketched_drift", over(f"""
    SELECT feature, n_base, true AS near_exact FROM ({" UNION ALL ".join(_ks(c) for c in MONITORED)})""", "household"))
def sketched_drift(t):
    """Drift from stored month sketches; the exact distances say whether it is within its stated error."""
    months = written(t, MONITORED)
    store = stored_sketches(t, months)
    current = F.col("month") >= DEMO_CUTOFF
    found = sketch_drift(store.merged(~current), store.merged(current))
    exact = d.numeric_drift(*sides_of(months), MONITORED).select(F.col("feature").alias("exact_feature"), F.col("ks").alias("exact_ks"))
    near = F.abs(F.col("ks") - F.col("exact_ks")) <= 2 * RANK_ERROR + 2 / GRID
    return found.join(exact, F.col("feature") == F.col("exact_feature")).select("feature", "n_base", near.alias("near_exact"))


@query("sketched_bounds", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, true AS p1_near, true AS p99_near FROM household WHERE month_slot IS NOT NULL" for c in MONITORED),
    "household"))
def sketched_bounds(t):
    """p1 and p99 of all months from their sketches, with their exact ranks checked."""
    months = written(t, MONITORED)
    bounds = sketch_quantiles(stored_sketches(t, months).merged(), {"p1": 0.01, "p99": 0.99})
    rows = long_form(months.filter("month_slot is not null"), MONITORED).join(F.broadcast(bounds), "feature")  # one row a feature
    value, n = F.col("value"), F.count("value")

    def near(name: str, p: float):
        below, upto = F.count_if(value < F.col(name)) / n, F.count_if(value <= F.col(name)) / n
        return ((below <= p + 2 * RANK_ERROR) & (upto >= p - 2 * RANK_ERROR)).alias(f"{name}_near")

    return rows.groupBy("feature").agg(F.max("n").alias("n"), near("p1", 0.01), near("p99", 0.99))
