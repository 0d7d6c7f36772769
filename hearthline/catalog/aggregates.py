"""Queries for aggregates, profiles and evaluation metrics."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import over
from hearthline.catalog.registry import query, rounded, text
from hearthline.catalog.survey_views import DEMO_CUTOFF
from hearthline.operators import metrics as m
from hearthline.operators import people as pe
from hearthline.operators import profile as p
from hearthline.operators.joins import join_income_consumption
from hearthline.operators.sampling import split_counts

LABELS = [*fv.STRESS_LABELS, fv.COMPOSITE_LABEL]
FLAGS = ["is_healthy_hh_min", "is_hospitalised_hh_any", "is_on_regular_medication_hh_any",
         "has_bank_account_hh_any", "has_health_insurance_hh_any", "education_rank_hh_max"]
KEYS = "household_id, cast(month_slot AS VARCHAR) AS month_slot"


def prevalence_sql(view: str, group: str | None = None) -> str:
    lead = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS label, cast(sum({c}) AS BIGINT) AS positives, count({c}) AS n_rows, "
        f"round(avg({c}), 6) AS mean FROM {view}{tail}" for c in LABELS)


@query("stress_by_state", over(prevalence_sql("household", "state"), "household"))
def stress_by_state(t):
    return p.label_prevalence(t.household, groups=["state"]).withColumn("mean", F.round("mean", 6))


@query("poi_household_agg", over(f"""
    SELECT file_stamp, {KEYS}, {", ".join(FLAGS)}, round(age_years_hh_mean, 6) AS age_years_hh_mean,
           gender_hh_mode, occupation_type_hh_mode, education_level_hh_mode, num_members
    FROM people_by_file""", "people_by_file"))
def poi_household_agg(t):
    return pe.poi_household_agg(t.poi).select(
        "file_stamp", "household_id", text("month_slot"), *FLAGS, rounded("age_years_hh_mean"),
        *fv.PEOPLE_CATEGORIES.values(), "num_members")


@query("poi_reaggregate", over(f"""
    SELECT {KEYS}, {", ".join(FLAGS)}, round(age_years_hh_mean, 6) AS age_years_hh_mean,
           gender_hh_mode, occupation_type_hh_mode, education_level_hh_mode, num_members
    FROM people""", "people"))
def poi_reaggregate(t):
    return t.people.select("household_id", text("month_slot"), *FLAGS, rounded("age_years_hh_mean"),
                           *fv.PEOPLE_CATEGORIES.values(), "num_members")


@query("first_nonnull_by_order", over("""
    SELECT household_id,
           arg_min(gender, struct_pack(a := file_stamp, b := member_id)) FILTER (WHERE gender IS NOT NULL) AS gender_first,
           arg_min(education_level, struct_pack(a := file_stamp, b := member_id))
               FILTER (WHERE education_level IS NOT NULL) AS education_level_first
    FROM poi GROUP BY household_id""", "poi"))
def first_nonnull_by_order(t):
    return pe.first_nonnull_by_order(t.poi, ["household_id"], ["gender", "education_level"],
                                     ["file_stamp", "member_id"])


@query("household_mode", over("""
    SELECT household_id, occupation_type AS occupation_type_mode FROM (
    SELECT household_id, occupation_type, row_number() OVER (
           PARTITION BY household_id ORDER BY count(*) DESC, occupation_type) AS r
    FROM poi WHERE occupation_type IS NOT NULL GROUP BY household_id, occupation_type) WHERE r = 1""", "poi"))
def household_mode(t):
    return pe.household_mode(t.poi, ["household_id"], ["occupation_type"])


@query("label_prevalence", over(prevalence_sql("household"), "household"))
def label_prevalence(t):
    return p.label_prevalence(t.household).withColumn("mean", F.round("mean", 6))


@query("prevalence_rollup", over(" UNION ALL ".join(
    f"""SELECT 2 - grouping(state) - grouping(region_type) AS depth, state, region_type, '{c}' AS label, cast(sum({c}) AS BIGINT) AS positives,
        count({c}) AS n_rows, round(avg({c}), 6) AS mean FROM household GROUP BY ROLLUP (state, region_type)""" for c in fv.STRESS_LABELS),
    "household"))
def prevalence_rollup(t):
    return p.prevalence_rollup(t.household, ["state", "region_type"]).withColumn("mean", F.round("mean", 6))


@query("composite_distribution", over("""
    SELECT composite_stress_score AS score, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share,
           count(*) / sum(count(*)) OVER () < 0.01 AS is_rare
    FROM household GROUP BY composite_stress_score""", "household"))
def composite_distribution(t):
    return p.composite_distribution(t.household).withColumn("share", F.round("share", 9))


PROFILED = ["total_income", "income_all_members_from_wages", "income_household_from_rent", "exp_education",
            "exp_vacation", "age_group", "occupation_group", "is_hospitalised_hh_any", "gender_hh_mode"]


@query("null_profile", over(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct, "
    f"(count(*) - count({c})) * 100.0::DOUBLE / count(*) > 20 AS flagged FROM household"
    for c in PROFILED), "household"))
def null_profile(t):
    return p.null_profile(t.household, PROFILED, 20.0).withColumn("missing_pct", F.round("missing_pct", 6))


@query("overall_missing", over(f"""
    SELECT cast(sum(missing) AS BIGINT) AS missing_cells, round(avg(missing * 100.0::DOUBLE / n), 6) AS missing_pct
    FROM ({" UNION ALL ".join(f"SELECT count(*) AS n, count(*) - count({c}) AS missing FROM inc"
                              for c in ["file_stamp", *fv.INC_KEEP])})""", "inc"))
def overall_missing(t):
    return p.overall_missing(t.inc).withColumn("missing_pct", F.round("missing_pct", 6))


@query("sentinel_leftover", over(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = -99) AS left_over FROM inc"
    for c in fv.INCOME_AMOUNTS), "inc"))
def sentinel_leftover(t):
    return p.sentinel_leftover(t.inc)


@query("ratio_describe", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM household"
    for c in fv.RATIO_COLUMNS if c not in ("emi_to_income_ratio",)), "household"))
def ratio_describe(t):
    columns = [c for c in fv.RATIO_COLUMNS if c != "emi_to_income_ratio"]
    return p.ratio_describe(t.household, columns).withColumns({
        "mean": F.round("mean", 4), "std": F.round("std", 4), "median": F.round("median", 6)})


@query("date_range_states", over("""
    SELECT cast(min(month_slot) AS VARCHAR) AS first_month, cast(max(month_slot) AS VARCHAR) AS last_month,
           count(DISTINCT state) AS states FROM household""", "household"))
def date_range_states(t):
    return p.date_range_states(t.household).select(text("first_month"), text("last_month"), "states")


@query("region_counts", over("""
    SELECT region_type, count(*) AS n FROM household WHERE region_type IS NOT NULL GROUP BY 1""", "household"))
def region_counts(t):
    return p.value_counts(t.household, "region_type")


@query("top_states", over("""
    SELECT state, count(*) AS n FROM household GROUP BY state ORDER BY n DESC, state LIMIT 5""", "household"))
def top_states(t):
    return p.top_states(t.household)


LEVELLED = ["state", "region_type", "age_group", "occupation_group", "education_group", "gender_group"]


@query("category_levels", over(" UNION ".join(
    f"SELECT '{c}' AS feature, {c} AS level FROM household WHERE {c} IS NOT NULL" for c in LEVELLED), "household"))
def category_levels(t):
    return p.category_levels(t.household, LEVELLED)


@query("class_balance", over("""
    SELECT region_type, count(*) FILTER (WHERE debt_stress = 0) AS n_neg, count(*) FILTER (WHERE debt_stress = 1) AS n_pos,
           round(count(*) FILTER (WHERE debt_stress = 0) / greatest(count(*) FILTER (WHERE debt_stress = 1), 1), 2)
           AS scale_pos_weight FROM household GROUP BY region_type""", "household"))
def class_balance(t):
    return m.class_balance(t.household, "debt_stress", ["region_type"])


# A rule over one survey predicts the label of the next stage: spending alone against debt.
def judged(t):
    score = F.col("emi_to_income_ratio") + F.col("discretionary_to_expense_ratio")
    return t.household.select("region_type", F.col("debt_stress").alias("actual"), score.alias("score"),
                              (score > 0.4).cast("int").alias("predicted"))


JUDGED = """(SELECT region_type, debt_stress AS actual,
                    emi_to_income_ratio + discretionary_to_expense_ratio AS score,
                    CASE WHEN emi_to_income_ratio + discretionary_to_expense_ratio > 0.4 THEN 1 ELSE 0 END AS predicted
             FROM household)"""


@query("confusion_matrix", over(f"""
    SELECT region_type, actual, predicted, coalesce(n, 0) AS n FROM (
    SELECT * FROM (SELECT DISTINCT region_type FROM household),
    (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS grid(actual, predicted))
    LEFT JOIN (SELECT region_type, actual, predicted, count(*) AS n FROM {JUDGED} GROUP BY ALL)
    USING (region_type, actual, predicted)""", "household"))
def confusion_matrix(t):
    return m.confusion_matrix(judged(t), "actual", "predicted", groups=["region_type"])


@query("confusion_summary", over(f"""
    SELECT region_type, tn, fp, fn, tp, round(tp / (tp + fn + 1e-9) * 100, 6) AS recall_pct,
           round(fp / (fp + tn + 1e-9) * 100, 6) AS fpr_pct FROM (
    SELECT region_type, count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn,
           count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
           count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn,
           count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp FROM {JUDGED} GROUP BY region_type)""",
    "household"))
def confusion_summary(t):
    return m.confusion_summary(judged(t), "actual", "predicted", ["region_type"]).withColumns({
        "recall_pct": F.round("recall_pct", 6), "fpr_pct": F.round("fpr_pct", 6)})


@query("classification_report", over(f"""
    , cls AS (SELECT region_type, c AS class,
         count(*) FILTER (WHERE actual = c AND predicted = c) AS tp, count(*) FILTER (WHERE predicted = c) AS np,
         count(*) FILTER (WHERE actual = c) AS support FROM {JUDGED}, (VALUES (0), (1)) AS g(c) GROUP BY ALL),
    pr AS (SELECT region_type, class, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
         CASE WHEN np + support = 0 THEN 0 ELSE 2 * tp / (np + support) END AS f1, support, tp FROM cls)
    SELECT region_type, cast(class AS VARCHAR) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall,
           round(f1, 9) AS f1, support FROM pr
    UNION ALL SELECT region_type, 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9),
           round(sum(tp) / sum(support), 9), cast(sum(support) AS BIGINT) FROM pr GROUP BY region_type
    UNION ALL SELECT region_type, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
           cast(sum(support) AS BIGINT) FROM pr GROUP BY region_type
    UNION ALL SELECT region_type, 'weighted avg', round(sum(precision * support) / sum(support), 9),
           round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
           cast(sum(support) AS BIGINT) FROM pr GROUP BY region_type""", "household"))
def classification_report(t):
    report = m.classification_report(judged(t), "actual", "predicted", groups=["region_type"])
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("auc_roc", over(f"""
    SELECT region_type, round((sum(CASE WHEN actual = 1 THEN r ELSE 0 END) - max(np) * (max(np) + 1) / 2.0::DOUBLE)
           / (max(np)::DOUBLE * max(nn)), 9) AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY region_type ORDER BY score)
            + (count(*) OVER (PARTITION BY region_type, score) - 1) / 2.0::DOUBLE AS r,
           count(*) FILTER (WHERE actual = 1) OVER (PARTITION BY region_type) AS np,
           count(*) FILTER (WHERE actual = 0) OVER (PARTITION BY region_type) AS nn
    FROM {JUDGED}) GROUP BY region_type""", "household"))
def auc_roc(t):
    return m.auc_roc(judged(t), "score", "actual", ["region_type"]).withColumn("auc", F.round("auc", 9))


@query("auc_roc_documents", """
    SELECT target, round((sum(CASE WHEN actual = 1 THEN r ELSE 0 END) - max(np) * (max(np) + 1) / 2.0::DOUBLE)
           / (max(np)::DOUBLE * max(nn)), 9) AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY target ORDER BY score)
            + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0::DOUBLE AS r,
           count(*) FILTER (WHERE actual = 1) OVER (PARTITION BY target) AS np,
           count(*) FILTER (WHERE actual = 0) OVER (PARTITION BY target) AS nn
    FROM (SELECT 'toxic' AS target, toxic AS actual, n_chars AS score FROM documents JOIN labels USING (doc_id)
          UNION ALL SELECT 'quality', quality, n_chars FROM documents JOIN labels USING (doc_id)))
    GROUP BY target""")
def auc_roc_documents(t):
    rows = t.table("documents").select("doc_id", "n_chars").join(t.table("labels"), "doc_id").unpivot(
        ["n_chars"], ["toxic", "quality"], "target", "actual")
    return m.auc_roc(rows, "n_chars", "actual", ["target"]).withColumn("auc", F.round("auc", 9))


@query("mae_rmse", over("""
    SELECT region_type, round(avg(abs(composite_stress_score - guess)), 9) AS mae,
           round(sqrt(avg((composite_stress_score - guess) * (composite_stress_score - guess))), 9) AS rmse FROM (
    SELECT region_type, composite_stress_score, food_to_expense_ratio + least(emi_to_income_ratio, 1.0) AS guess
    FROM household) GROUP BY region_type""", "household"))
def mae_rmse(t):
    guess = t.household.withColumn(
        "guess", F.col("food_to_expense_ratio") + F.least("emi_to_income_ratio", F.lit(1.0)))
    return m.mae_rmse(guess, "composite_stress_score", "guess", ["region_type"]).select(
        "region_type", rounded("mae", 9), rounded("rmse", 9))


@query("split_counts", over(f"""
    SELECT count(*) FILTER (WHERE month_slot < DATE '{DEMO_CUTOFF}') AS train_rows,
           count(*) FILTER (WHERE month_slot >= DATE '{DEMO_CUTOFF}') AS test_rows FROM household""", "household"))
def split(t):
    return split_counts(t.household, cutoff=DEMO_CUTOFF)


BOUNDED = ["savings_proxy", "food_to_expense_ratio", "exp_food_adjusted", "income_all_members_from_wages",
           "age_years_hh_mean"]


@query("feature_bounds", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 4) AS p1, round(quantile_cont({c}, 0.99), 4) AS p99 "
    f"FROM household" for c in BOUNDED), "household"))
def feature_bounds(t):
    return p.feature_bounds(t.household, BOUNDED).select("feature", rounded("p1", 4), rounded("p99", 4))


@query("training_feature_bounds", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 4) AS p1, round(quantile_cont({c}, 0.99), 4) AS p99 "
    f"FROM household HAVING count({c}) > 0" for c in fv.NUMERIC_FEATURES), "household"))
def training_feature_bounds(t):
    """Bounds of every numeric feature that models train on."""
    return p.feature_bounds(t.household, [c for c in fv.NUMERIC_FEATURES if c in t.household.columns]).select(
        "feature", rounded("p1", 4), rounded("p99", 4))


def _raw_number(c: str) -> str:
    return f"try_cast(trim({c}) AS DOUBLE) = -99"


INC_RAW = [*fv.INC_COLUMNS, "file_stamp"]
INC_CLEAN = ["file_stamp", *fv.INC_KEEP]


@query("raw_vs_clean_diff", over(f"""
    SELECT 'INC' AS dataset, rn AS raw_rows, cn AS clean_rows, cn - rn AS row_delta,
           {len(INC_CLEAN) - len(INC_RAW)} AS column_delta,
           round(cm * 100.0::DOUBLE / (cn * {len(INC_CLEAN)}) - rm * 100.0::DOUBLE / (rn * {len(INC_RAW)}), 9)
               AS missing_pct_delta, rs - cs AS sentinels_removed
    FROM (SELECT count(*) AS rn, {" + ".join(f"(count(*) - count({c}))" for c in INC_RAW)} AS rm,
                 {" + ".join(f"count(*) FILTER (WHERE {_raw_number(c)})" for c in INC_RAW)} AS rs FROM inc_raw),
         (SELECT count(*) AS cn, {" + ".join(f"(count(*) - count({c}))" for c in INC_CLEAN)} AS cm,
                 {" + ".join(f"count(*) FILTER (WHERE {c} = -99)" for c in fv.INCOME_AMOUNTS)} AS cs FROM inc)""",
    "inc_raw", "inc"))
def raw_vs_clean_diff(t):
    return p.raw_vs_clean_diff(t.inc_raw, t.inc, "INC").withColumn(
        "missing_pct_delta", F.round("missing_pct_delta", 9))


#: The columns that the given tables' surveys have, raw and clean, and the marker of missing values.
PLACE_RAW = "file_stamp HH_ID STATE HR DISTRICT REGION_TYPE STRATUM MONTH_SLOT RESPONSE_STATUS".split()
PLACE = "file_stamp household_id state homogeneous_region district region_type stratum month_slot".split()
CON_RAW = [*PLACE_RAW, "MONTH", *[c for c in fv.CON_COLUMNS if fv.CON_COLUMNS[c] in (
    "total_expenditure_adjusted", "exp_food_adjusted", "exp_restaurants_adjusted", "exp_recreation", "exp_education", "exp_health",
    "exp_all_emis", "exp_vacation")]]
CON_CLEAN = [*PLACE, "reference_month", *[fv.CON_COLUMNS[c] for c in CON_RAW[len(PLACE_RAW) + 1:]]]
NOT_GIVEN = {"relation_with_head_of_household", "religion", "caste", "caste_category"}
POI_RAW = ["file_stamp", *[c for c, name in fv.POI_COLUMNS.items() if name not in NOT_GIVEN]]
POI_CLEAN = ["file_stamp", *[c for c in fv.POI_KEEP if c not in NOT_GIVEN]]
SURVEYS = {"INC": ("inc", INC_RAW, INC_CLEAN, "-99"), "CON": ("con", CON_RAW, CON_CLEAN, "-99"), "POI": ("poi", POI_RAW, POI_CLEAN, "-100")}


def _cells(view: str, columns: list[str], sentinel: str) -> str:
    marked = " + ".join(f"count(*) FILTER (WHERE try_cast(trim(cast({c} AS VARCHAR)) AS DOUBLE) = {sentinel})" for c in columns)
    return f"(SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in columns)} AS missing, {marked} AS marked FROM {view})"


@query("raw_vs_clean_all", over(" UNION ALL ".join(f"""
    SELECT '{name}' AS dataset, r.n AS raw_rows, c.n AS clean_rows, c.n - r.n AS row_delta, {len(clean) - len(raw)} AS column_delta,
           round(c.missing * 100.0::DOUBLE / (c.n * {len(clean)}) - r.missing * 100.0::DOUBLE / (r.n * {len(raw)}), 9) AS missing_pct_delta,
           r.marked - c.marked AS sentinels_removed
    FROM {_cells(f"{view}_raw", raw, sentinel)} r, {_cells(view, clean, sentinel)} c"""
    for name, (view, raw, clean, sentinel) in SURVEYS.items()), "inc", "con", "poi"))
def raw_vs_clean_all(t):
    """What cleaning changed in each of the three surveys; money is marked by -99, ages by -100."""
    tables = {"INC": (t.inc_raw, t.inc), "CON": (t.con_raw, t.con), "POI": (t.poi_raw, t.poi)}
    parts = [p.raw_vs_clean_diff(*tables[name], name, float(SURVEYS[name][3])) for name in SURVEYS]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("missing_pct_delta", F.round("missing_pct_delta", 9))


def scorecard(t):
    return p.quality_scorecard({
        "income rows present": (t.inc, F.count(F.lit(1)) > 0),
        "no sentinel in income": (t.inc, F.count_if(F.col("total_income") == -99) == 0),
        "income mostly known": (t.inc, F.count("total_income") > 0.95 * F.count(F.lit(1))),
        "ages within 0-110": (t.poi, F.max("age_years") <= 110),
        "every month joined": (join_income_consumption(t.inc, t.con), F.countDistinct("file_stamp") >= 80),
        "labels are 0 or 1": (t.household, F.max(F.greatest(*fv.STRESS_LABELS)) <= 1),
        "debt label is rare": (t.household, F.avg("debt_stress") < 0.1),
    })


SCORECARD = """
    SELECT 'income rows present' AS check_name, count(*) > 0 AS passed FROM inc
    UNION ALL SELECT 'no sentinel in income', count(*) FILTER (WHERE total_income = -99) = 0 FROM inc
    UNION ALL SELECT 'income mostly known', count(total_income) > 0.95 * count(*) FROM inc
    UNION ALL SELECT 'ages within 0-110', max(age_years) <= 110 FROM poi
    UNION ALL SELECT 'every month joined', count(DISTINCT file_stamp) >= 80 FROM joined
    UNION ALL SELECT 'labels are 0 or 1',
        max(greatest(financial_stress, food_stress, debt_stress, health_stress)) <= 1 FROM household
    UNION ALL SELECT 'debt label is rare', avg(debt_stress) < 0.1 FROM household"""


@query("quality_scorecard", over(SCORECARD, "household", "poi"))
def quality_scorecard(t):
    return scorecard(t)


@query("scorecard_total", over(f"""
    SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total FROM ({SCORECARD})""", "household", "poi"))
def scorecard_total(t):
    return p.scorecard_total(scorecard(t))
