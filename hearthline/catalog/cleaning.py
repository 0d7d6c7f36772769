"""Queries for the cleaning operators."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import (
    money_of, number_of, over, slot_of, text_list, text_of, yes_no_of)
from hearthline.catalog.registry import query, text
from hearthline.operators import cleaning as c


@query("filter_accepted", over("""
    SELECT HH_ID, MONTH, TOT_INC FROM inc_raw WHERE RESPONSE_STATUS = 'Accepted'""", "inc_raw"))
def filter_accepted(t):
    return c.filter_accepted(t.inc_raw).select("HH_ID", "MONTH", "TOT_INC")


@query("rename_present", over("""
    SELECT HH_ID AS household_id, STATE AS state, MONTH_SLOT AS month_slot, TOT_INC AS total_income,
           INC_OF_ALL_MEMS_FRM_WAGES AS income_all_members_from_wages, PSU_ID AS primary_sampling_unit_id,
           RESPONSE_STATUS AS response_status FROM inc_raw""", "inc_raw"))
def rename_present(t):
    return c.rename_present(t.inc_raw, fv.INC_COLUMNS).select(
        "household_id", "state", "month_slot", "total_income", "income_all_members_from_wages",
        "primary_sampling_unit_id", "response_status")


@query("select_present", over(f"""
    SELECT {", ".join(f"{raw} AS {clean}" for raw, clean in {
        **fv.MONTHLY_COLUMNS, "ADJ_TOT_EXP": "total_expenditure_adjusted",
        "ADJ_M_EXP_FOOD": "exp_food_adjusted", "ADJ_M_EXP_RESTAURANTS": "exp_restaurants_adjusted",
        "M_EXP_RECREATION": "exp_recreation", "M_EXP_EDU": "exp_education", "M_EXP_HEALTH": "exp_health",
        "M_EXP_ALL_EMIS": "exp_all_emis", "M_EXP_VACATION": "exp_vacation"}.items()
        if clean not in ("age_group", "occupation_group", "education_group", "gender_group",
                         "household_size_group"))} FROM con_raw""", "con_raw"))
def select_present(t):
    return c.select_present(c.rename_present(t.con_raw, fv.CON_COLUMNS), fv.CON_KEEP)


@query("to_numeric_coerce", over(f"""
    SELECT HH_ID, MONTH, {number_of('INC_OF_ALL_MEMS_FRM_WAGES')} AS wages,
           {number_of('INC_OF_HH_FRM_RENT')} AS rent, {number_of('INC_OF_HH_FRM_SELF_PRODN')} AS own_production,
           {number_of('INC_OF_HH_FRM_BIZ_PROFIT')} AS business FROM inc_raw""", "inc_raw"))
def to_numeric_coerce(t):
    columns = {"INC_OF_ALL_MEMS_FRM_WAGES": "wages", "INC_OF_HH_FRM_RENT": "rent",
               "INC_OF_HH_FRM_SELF_PRODN": "own_production", "INC_OF_HH_FRM_BIZ_PROFIT": "business"}
    return c.to_numeric_coerce(t.inc_raw, columns).select(
        "HH_ID", "MONTH", *[F.col(raw).alias(short) for raw, short in columns.items()])


@query("sentinel_to_null", over(f"""
    SELECT HH_ID, MONTH, {money_of('TOT_INC')} AS total, {money_of('INC_OF_HH_FRM_PVT_TRF')} AS transfers,
           {money_of('INC_OF_HH_FRM_BIZ_PROFIT')} AS business FROM inc_raw""", "inc_raw"))
def sentinel_to_null(t):
    columns = {"TOT_INC": "total", "INC_OF_HH_FRM_PVT_TRF": "transfers", "INC_OF_HH_FRM_BIZ_PROFIT": "business"}
    numbers = c.to_numeric_coerce(t.inc_raw, columns)
    return c.sentinel_to_null(numbers, columns, fv.MONEY_SENTINEL).select(
        "HH_ID", "MONTH", *[F.col(raw).alias(short) for raw, short in columns.items()])


@query("string_null_to_null", over(f"""
    SELECT HH_ID, MONTH, {text_of('AGE_GROUP')} AS age_group, {text_of('OCCUPATION_GROUP')} AS occupation_group,
           {text_of('EDU_GROUP')} AS edu_group, {text_of('GENDER_GROUP')} AS gender_group FROM inc_raw""", "inc_raw"))
def string_null_to_null(t):
    return c.string_null_to_null(t.inc_raw).select(
        "HH_ID", "MONTH", F.col("AGE_GROUP").alias("age_group"),
        F.col("OCCUPATION_GROUP").alias("occupation_group"), F.col("EDU_GROUP").alias("edu_group"),
        F.col("GENDER_GROUP").alias("gender_group"))


@query("parse_month_slot", f"""
    SELECT o_orderkey, slot, cast({slot_of('slot')} AS VARCHAR) AS month_slot FROM (
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN upper(strftime(o_orderdate, '%b %Y'))
                            WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN 'n/a'
                            ELSE strftime(o_orderdate, '%b %Y') END AS slot FROM orders)""")
def parse_month_slot(t):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    slot = F.date_format(day, "MMM yyyy")
    raw = t.table("orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, F.upper(slot)).when(key % 5 == 1, F.date_format(day, "yyyy-MM"))
        .when(key % 5 == 2, F.lit("n/a")).otherwise(slot).alias("slot"))
    parsed = c.parse_month_slot(raw.withColumn("month_slot", F.col("slot")))
    return parsed.select("o_orderkey", "slot", text("month_slot"))


@query("yn_to_int", over(f"""
    SELECT MEM_ID, {yes_no_of('IS_HEALTHY')} AS healthy, {yes_no_of('IS_ON_ORAL_MEDICATION')} AS medication,
           {yes_no_of('IS_HOSPITALISED')} AS hospitalised, {yes_no_of('HAS_MOBILE')} AS mobile FROM poi_raw""",
    "poi_raw"))
def yn_to_int(t):
    columns = {"IS_HEALTHY": "healthy", "IS_ON_ORAL_MEDICATION": "medication",
               "IS_HOSPITALISED": "hospitalised", "HAS_MOBILE": "mobile"}
    return c.yn_to_int(t.poi_raw, columns).select(
        "MEM_ID", *[F.col(raw).alias(short) for raw, short in columns.items()])


@query("education_rank", over(f"""
    SELECT MEM_ID, EDU AS education_level,
           list_position({text_list(fv.EDUCATION_LEVELS)}, EDU) - 1 AS education_rank FROM poi_raw""", "poi_raw"))
def education_rank(t):
    return c.education_rank(t.poi_raw.withColumnRenamed("EDU", "education_level")).select(
        "MEM_ID", "education_level", "education_rank")


def _dated(df, *columns):
    return df.select(*[text(x) if x == "month_slot" else F.col(x) for x in columns])


@query("clean_inc", over(f"""
    SELECT file_stamp, {", ".join("cast(month_slot AS VARCHAR) AS month_slot" if x == "month_slot" else x
                                  for x in fv.INC_KEEP)} FROM inc""", "inc"))
def clean_inc(t):
    return _dated(t.inc, "file_stamp", *fv.INC_KEEP)


@query("clean_poi", over(f"""
    SELECT * REPLACE (cast(month_slot AS VARCHAR) AS month_slot) FROM poi""", "poi"))
def clean_poi(t):
    return _dated(t.poi, *t.poi.columns)


@query("clean_con", over("""
    SELECT * REPLACE (cast(month_slot AS VARCHAR) AS month_slot) FROM con""", "con"))
def clean_con(t):
    return _dated(t.con, *t.con.columns)


@query("drop_leakage", over(f"""
    SELECT * EXCLUDE (total_income, total_expenditure_adjusted)
           REPLACE (cast(month_slot AS VARCHAR) AS month_slot) FROM household""", "household"))
def drop_leakage(t):
    kept = c.drop_leakage(t.household).drop("recency_weight")
    return _dated(kept, *kept.columns)


@query("drop_null_label", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, savings_label FROM (
    SELECT household_id, month_slot, CASE WHEN total_income IS NOT NULL THEN
           CASE WHEN savings_proxy < 0 THEN 1 ELSE 0 END END AS savings_label FROM household)
    WHERE savings_label IS NOT NULL""", "household"))
def drop_null_label(t):
    labelled = t.household.withColumn("savings_label", F.when(
        F.col("total_income").isNotNull(), (F.col("savings_proxy") < 0).cast("int")))
    return c.drop_null_label(labelled, "savings_label").select(
        "household_id", text("month_slot"), "savings_label")


@query("resolve_duplicate_columns", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, reference_month, exp_food_adjusted
    FROM con""", "con"))
def resolve_duplicate_columns(t):
    right = c.resolve_duplicate_columns(t.inc, t.con, ["household_id", "month_slot", "reference_month"])
    return right.select("household_id", text("month_slot"), "reference_month", "exp_food_adjusted")
