import re

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def plan_of(name, spark):
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))]" in plan_of("compact_projection", spark)
    assert "s_acctbal" not in re.search(r"ReadSchema: struct<s_[^>]*>", plan_of("facet_counts", spark)).group(0)


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of("owner_scope", spark) and "Partial" in plan_of("owner_scope", spark)
