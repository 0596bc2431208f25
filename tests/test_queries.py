"""Every registered query: its plan, and its rows against its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from docketlens.plans import registry
from oracle_check import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def check_plan(plan):
    """No all-pairs join, and every window partitions by a column before it orders by one."""
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"windowspecdefinition\((.*)", plan):
        assert not re.match(r"\S+ (ASC|DESC)", spec), spec


def test_contract(spark):
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    check_plan(df._jdf.queryExecution().executedPlan().toString())
    assert differences(df, con, registry.ORACLES[name]) == []
