"""Plan shape of the registered queries: no Python in the hot path, no nested-loop or cartesian
joins, filters pushed into the parquet scans, per-key top-k as WindowGroupLimit."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from studyhall.plans import registry

BATCH_KEYS = sorted(k for k in registry.queries() if not k.startswith("stream_"))


def plan_of(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + "\n" + qe.optimizedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_of(E.queries()[k](spark, SF_SMALL)) for k in BATCH_KEYS}


def test_no_python_udf(plans):
    bad = [k for k, p in plans.items() if "PythonUDF" in p or "BatchEvalPython" in p or "ArrowEvalPython" in p]
    assert bad == []


def test_no_nested_loop_or_cartesian_join(plans):
    bad = [k for k, p in plans.items() if "BroadcastNestedLoopJoin" in p or "CartesianProduct" in p]
    assert bad == []


def test_filters_reach_the_scan(plans):
    p = plans["center_upcoming_sessions"]
    assert "PushedFilters: [IsNotNull(scheduled_at), Not(EqualTo(status,completed))" in p or \
        ("PushedFilters" in p and "scheduled_at" in p)


def test_projection_is_pruned(spark):
    df = E.queries()["wallet_balance"](spark, SF_SMALL)
    p = plan_of(df)
    # the ledger scan reads only the columns the balance needs
    ledger_scans = [line for line in p.splitlines() if "wallet_transactions" in line and "ReadSchema" in line]
    assert ledger_scans and all("description" not in line and "metadata" not in line for line in ledger_scans)


def test_per_user_pages_use_window_group_limit(plans):
    assert "WindowGroupLimit" in plans["wallet_history"]
    assert "WindowGroupLimit" in plans["teacher_sessions"]


def test_radius_join_is_an_equi_join(plans):
    p = plans["student_nearby_centers"]
    assert ("SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p) and "_ci" in p


def test_page_queries_take_ordered(plans):
    assert "TakeOrderedAndProject" in plans["user_search"]
