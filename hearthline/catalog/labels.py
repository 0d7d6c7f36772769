"""Queries for labels, ratio features and engineered features."""

from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.catalog.oracle_views import flag_of, over
from hearthline.catalog.registry import query, text
from hearthline.functions import features as ft
from hearthline.functions import labels as lb
from hearthline.operators.joins import join_income_consumption, join_people

SQL_KEYS = "household_id, cast(month_slot AS VARCHAR) AS month_slot"


def keyed(df, **columns):
    return df.select("household_id", text("month_slot"), *[c.alias(n) for n, c in columns.items()])


def joined(t):
    return join_people(join_income_consumption(t.inc, t.con), t.people)


def month_pair(t):
    return join_income_consumption(t.inc, t.con)


def label_query(name: str, column: str, source, build):
    @query(name, over(f"SELECT {SQL_KEYS}, {column} FROM household", "household"))
    def run(t):
        return keyed(source(t), **{column: build()})


label_query("label_financial", "financial_stress", month_pair, lambda: lb.label_financial(
    F.col("total_expenditure_adjusted"), F.col("total_income")))
label_query("label_food", "food_stress", month_pair, lambda: lb.label_food(
    F.col("exp_food_adjusted"), F.col("total_expenditure_adjusted")))
label_query("label_debt", "debt_stress", month_pair, lambda: lb.label_debt(
    F.col("exp_all_emis"), F.col("total_income")))
label_query("label_health", "health_stress", joined, lambda: lb.label_health(
    F.col("is_hospitalised_hh_any"), F.col("is_on_regular_medication_hh_any")))


@query("label_composite", over(
    f"SELECT {SQL_KEYS}, {', '.join(fv.STRESS_LABELS)}, composite_stress_score FROM household", "household"))
def label_composite(t):
    return lb.compute_labels(joined(t)).select(
        "household_id", text("month_slot"), *fv.STRESS_LABELS, fv.COMPOSITE_LABEL)


@query("label_health_che", over(f"""
    SELECT {SQL_KEYS}, che AS health_stress, financial_stress + food_stress + debt_stress + che AS composite_stress_score
    FROM (SELECT *, {flag_of('health_to_expense_ratio > 0.10')} AS che FROM household)""", "household"))
def label_health_che(t):
    return lb.relabel_health_che(t.household).select(
        "household_id", text("month_slot"), "health_stress", fv.COMPOSITE_LABEL)


def ratio_query(name: str, *columns: str):
    @query(name, over(f"SELECT {SQL_KEYS}, {', '.join(columns)} FROM household", "household"))
    def run(t):
        return lb.compute_ratios(month_pair(t)).select("household_id", text("month_slot"), *columns)


ratio_query("emi_to_income_ratio", "emi_to_income_ratio")
ratio_query("expense_ratios", "food_to_expense_ratio", "health_to_expense_ratio", "education_to_expense_ratio")
ratio_query("discretionary_to_expense_ratio", "discretionary_to_expense_ratio")
ratio_query("savings_proxy", "savings_proxy")
ratio_query("income_diversity_score", "income_diversity_score")


def feature_query(name: str):
    @query(name, over(f"SELECT {SQL_KEYS}, {name} FROM household", "household"))
    def run(t):
        return t.household.select("household_id", text("month_slot"), name)


for feature in fv.ENGINEERED_FEATURES:
    feature_query(feature)


@query("savings_buffer_wages", over(f"""
    SELECT {SQL_KEYS}, savings_proxy / (abs(savings_proxy) + income_all_members_from_wages + 1e-9)
           AS savings_buffer_months FROM household""", "household"))
def savings_buffer_wages(t):
    return ft.engineer_features(t.household, "wages").select(
        "household_id", text("month_slot"), "savings_buffer_months")


@query("recency_weight", over(f"""
    SELECT {SQL_KEYS}, CASE WHEN month_slot >= DATE '2000-01-01' THEN 2.0 ELSE 1.0 END::DOUBLE AS recency_weight
    FROM household""", "household"))
def recency_weight(t):
    return keyed(t.household, recency_weight=ft.recency_weight(F.col("month_slot"), "2000-01-01"))
