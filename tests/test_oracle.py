"""Registered queries against their SQL on the smallest data."""

import os
from pathlib import Path

import pytest

from oracle_check import compare, connect
from talkmill.plans.registry import all_oracles, all_queries

SF_DIR = os.environ.get("TALKMILL_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(all_queries())
#: Queries without rows on the smallest data.
EMPTY = {"merge_candidates_left"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    if name not in all_oracles():
        pytest.skip("rows only")
    wanted = "no rows" if name in EMPTY else None
    assert compare(spark, connect(SF_DIR), SF_DIR, all_queries()[name], all_oracles()[name]) == wanted


def test_entry():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    assert entry.entry(SparkSession.getActiveSession()).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
