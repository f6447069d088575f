"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tableworks import plans


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_result(spark, sf, con, name):
    assert compare(plans.QUERIES[name](spark, sf), con, plans.ORACLES[name]) == []


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_query_plans_a_cross_join(spark, sf):
    for name in ("knn_topk", "retrieve_rerank_context", "replicate_to", "value_distribution", "task_gate", "validate_tool_calls"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scan_reads_only_what_is_needed(spark, sf):
    plan = plans.QUERIES["profile_numeric_target"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_extendedprice:double>" in plan
