"""Queries that pass over the household months several times compute them once."""

import datetime
from types import SimpleNamespace

import pytest

from hearthline.catalog import load_registry
from hearthline.catalog.drift import CATEGORICAL, MONITORED
from hearthline.catalog.training import NUMBERS, ROW, WORDS
from hearthline.operators import profile as p

MONTHS = [datetime.date(1998, 5, 1), datetime.date(1999, 12, 1), datetime.date(2000, 1, 1), datetime.date(2001, 7, 1), None]


@pytest.fixture(scope="module")
def counted(spark):
    """Tables whose household rows are counted each time they are computed."""
    amounts = list(dict.fromkeys([*MONITORED, *NUMBERS]))
    words = list(dict.fromkeys([*CATEGORICAL, *WORDS]))
    schema = ", ".join(["household_id string", "month_slot date", *[f"{c} double" for c in amounts], *[f"{c} string" for c in words]])
    rows = [(f"h{i % 9}", MONTHS[i % 5], *[None if (i + k) % 11 == 0 else float((i * (k + 3)) % 17) for k in range(len(amounts))],
             *["abc"[(i + k) % 3] for k in range(len(words))]) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return seen, SimpleNamespace(spark=spark, household=spark.createDataFrame(rows, schema).mapInPandas(count, schema))


@pytest.mark.parametrize("name", ["numeric_drift", "drift_share", "monitored_drift_share", "sketched_drift", "sketched_bounds",
                                  "prepare_features"])
def test_months_are_computed_once(counted, name):
    seen, tables = counted
    before = seen.value
    assert load_registry()[name].run(tables).collect()
    assert seen.value - before == 60
    assert set(ROW) <= set(tables.household.columns)


def test_text_cells_are_only_parsed_where_a_sentinel_can_be(spark):
    texts = ["-99", " -99.0 ", "\t-9.9e1", "-990e-1d", "99", "x-99", "-", "- 99", "-99x", "NaN", "-Infinity", "", None, "12-99", "-100"]
    df = spark.createDataFrame([(t, -99.0) for t in texts], "t string, n double")
    parsed = df.filter("try_cast(trim(t) as double) = -99").count()
    row = p.profile_row(df, "d").first()
    assert parsed >= 3 and row.sentinel_cells == parsed + len(texts)
    assert p.profile_row(df, "d", 99.0).first().sentinel_cells == 1
    plan = p.profile_row(df, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "contains" in plan.lower()
