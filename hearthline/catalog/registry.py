"""Named queries and, where SQL can say it, the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.catalog.survey_views import SurveyTables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SurveyTables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the survey tables under its operator's name."""
    def register(run: Callable[[SurveyTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, sql)
        return run
    return register


def text(column: str, alias: str | None = None) -> Column:
    """Dates and timestamps travel as text, so that every engine prints them alike."""
    return F.col(column).cast("string").alias(alias or column)


def micros(column: str, alias: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).alias(alias)


def rounded(column: str, places: int = 6, alias: str | None = None) -> Column:
    return F.round(F.col(column), places).alias(alias or column)
