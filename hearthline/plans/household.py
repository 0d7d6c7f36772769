"""Raw surveys to the household stress dataset as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearthline.functions.labels import compute_labels, compute_ratios
from hearthline.operators.cleaning import clean_con, clean_inc, clean_poi, drop_leakage
from hearthline.operators.joins import join_income_consumption, join_people
from hearthline.operators.people import poi_household_agg, poi_reaggregate


def people_aggregate(poi: DataFrame) -> DataFrame:
    """Clean people table to the household aggregate."""
    return poi_reaggregate(poi_household_agg(poi))


def household_with_totals(inc: DataFrame, con: DataFrame, people: DataFrame,
                          health_label: str = "members") -> DataFrame:
    """Joined, labelled months with ratios; the totals are still in."""
    joined = join_people(join_income_consumption(inc, con), people)
    if health_label == "che":
        return compute_labels(compute_ratios(joined), "che")
    return compute_ratios(compute_labels(joined))


def stress_dataset(inc: DataFrame, con: DataFrame, people: DataFrame) -> DataFrame:
    """Clean months to the training dataset: label-defining totals dropped."""
    return drop_leakage(household_with_totals(inc, con, people))


def household_stress_dataset(inc_raw: DataFrame, con_raw: DataFrame, poi_raw: DataFrame) -> DataFrame:
    """The training dataset from raw surveys, in one plan."""
    return stress_dataset(clean_inc(inc_raw), clean_con(con_raw), people_aggregate(clean_poi(poi_raw)))
