"""Plan guards over every registered query: JVM-side expressions only, no
cross or nested-loop joins, pruned scans, and the bucketed range join."""

import os

import pytest

import __spark_entry__ as E
from wardstat.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("PythonUDF", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in QUERIES.items():
        out[name] = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_udf_or_cross_join(plans):
    for name, plan in plans.items():
        for word in FORBIDDEN:
            assert word not in plan, (name, word)


def test_scans_read_only_needed_columns(plans):
    # the flagship never reads price, quantity or comment-like columns
    plan = plans["provider_scorecard"]
    for col in ("l_extendedprice", "l_quantity", "o_totalprice", "p_name", "c_acctbal"):
        assert col not in plan, col


def test_range_joins_are_bucketed_equi_joins(plans):
    for name in ("index_stays", "readmissions", "provider_scorecard"):
        assert "_day_bucket" in plans[name], name


def test_queries_leave_nothing_cached(spark, plans):
    """Building every query persists nothing, so no query changes another's plan."""
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    for plan in plans.values():
        assert "InMemoryTableScan" not in plan
