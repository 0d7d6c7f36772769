"""The registered queries against their SQL.

A sample of every area runs by default; HEARTHLINE_ALL=1 runs all of them.
"""

import os

import pytest
from oracle_compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["stress_by_state", "clean_inc", "join_people", "bounds_check_join", "upsert_assessments", "auc_roc",
          "ratio_describe", "latency_p99_alert", "profile_from_answers", "stress_summary", "numeric_drift",
          "stratified_random_split", "incremental_skip_done", "stream_session_durations"]
NAMES = sorted(queries()) if os.environ.get("HEARTHLINE_ALL") else SAMPLE


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql().get(name))
    assert not result.startswith("FAIL"), result
