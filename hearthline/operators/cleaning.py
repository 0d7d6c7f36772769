"""Row-level cleaning of raw survey tables. Every operator is lazy and shuffle-free,
so the composed cleaners collapse into one projection over the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import fixed_values as fv

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def numeric(column: Column | str) -> Column:
    """Text to double; text that is not a finite number becomes null.

    The pattern guards `try_cast`, which would read '12d' as 12 and 'NaN' as NaN.
    """
    text = F.col(column) if isinstance(column, str) else column
    text = text.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def month_of(column: Column | str) -> Column:
    """'Jan 2014' to the first day of that month; anything else to null."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column,
                              F.lit("MMM yyyy")).cast("date")


def yes_no(column: Column | str) -> Column:
    answer = F.upper(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(answer == "Y", F.lit(1)).when(answer == "N", F.lit(0)).cast("int")


def rank_of_education(column: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in
                           ((level, i) for i, level in enumerate(fv.EDUCATION_LEVELS))
                           for x in pair])
    return F.try_element_at(ranks, F.col(column) if isinstance(column, str) else column)


def filter_accepted(df: DataFrame, column: str = "RESPONSE_STATUS") -> DataFrame:
    """Keep accepted responses; tables without a status column pass through."""
    return df.filter(F.col(column) == "Accepted") if column in df.columns else df


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({raw: clean for raw, clean in names.items() if raw in df.columns})


def select_present(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    return df.select([c for c in keep if c in df.columns])


def to_numeric_coerce(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: numeric(c) for c in columns if c in df.columns})


def sentinel_to_null(df: DataFrame, columns: Iterable[str], sentinel: float) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns if c in df.columns})


def string_null_to_null(df: DataFrame) -> DataFrame:
    """Exact, case-sensitive match of the null markers on every string column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(fv.STRING_NULLS), F.col(c)) for c in text})


def parse_month_slot(df: DataFrame, column: str = "month_slot") -> DataFrame:
    return df.withColumn(column, month_of(column)) if column in df.columns else df


def yn_to_int(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: yes_no(c) for c in columns if c in df.columns})


def education_rank(df: DataFrame, column: str = "education_level") -> DataFrame:
    return df.withColumn("education_rank", rank_of_education(column)) if column in df.columns else df


def drop_leakage(df: DataFrame, columns: Iterable[str] = tuple(fv.LEAKAGE_TOTALS)) -> DataFrame:
    """Drop the totals that define the labels."""
    return df.drop(*columns)


def model_features(label: str, features: Iterable[str]) -> list[str]:
    """The feature list of one model: the shared list without what would leak its label."""
    excluded = set(fv.EXCLUDED_FEATURES.get(label, []))
    return [f for f in features if f not in excluded]


def drop_null_label(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label])


def resolve_duplicate_columns(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The right side without columns the left side already has; keys stay."""
    keys = list(keys)
    return right.select(keys + [c for c in right.columns if c not in left.columns and c not in keys])


def _clean(df: DataFrame, names: Mapping[str, str], numbers: Iterable[str], sentinel: float,
           keep: Iterable[str]) -> DataFrame:
    numbers = list(numbers)
    df = rename_present(filter_accepted(df), names)
    df = to_numeric_coerce(df, numbers)
    df = sentinel_to_null(df, numbers, sentinel)
    return select_present(parse_month_slot(string_null_to_null(df)), keep)


def _with_stamp(keep: list[str]) -> list[str]:
    return ["file_stamp"] + keep


def clean_inc(raw: DataFrame) -> DataFrame:
    """Raw income table to its 19 clean columns (plus the source stamp when there is one)."""
    return _clean(raw, fv.INC_COLUMNS, fv.INCOME_AMOUNTS, fv.MONEY_SENTINEL, _with_stamp(fv.INC_KEEP))


def clean_con(raw: DataFrame) -> DataFrame:
    """Raw consumption table: household columns, the total and every known expense column."""
    return _clean(raw, fv.CON_COLUMNS, fv.CON_EXPENSE_COLUMNS.values(), fv.MONEY_SENTINEL,
                  _with_stamp(fv.CON_KEEP))


def clean_poi(raw: DataFrame) -> DataFrame:
    """Raw people table: members with 0/1 flags, age in years and an education rank."""
    flagged = yn_to_int(
        string_null_to_null(rename_present(filter_accepted(raw), fv.POI_COLUMNS)), fv.POI_YES_NO)
    ranked = education_rank(parse_month_slot(flagged))
    aged = sentinel_to_null(to_numeric_coerce(ranked, ["age_years"]), ["age_years"], fv.AGE_SENTINEL)
    return select_present(aged, _with_stamp(fv.POI_KEEP))
