"""Plan-level guards for the scale rules, over every registered query."""

import pytest

import __spark_entry__ as E
from answer_eval.plans import catalog
from conftest import SF_SMALL

# Operators that may run Python in tasks: the user-supplied answerer, the
# keyed-state streams (their results are read back from the sink),
# and the tag parser (t1; the tag form of a request).
PYTHON_ALLOWED = {"d1_score", "d1_scored_report", "d1_ledger", "t1_parse_tags", "s4_s6_request_participants",
                  "s7_request_errors"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "FlatMapGroupsInPandasWithState", "PythonUDF")
CROSS_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + "\n" + qe.optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_and_python_only_where_intended(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for node in CROSS_NODES:
        assert node not in plan, f"{name}: {node}"
    if name not in PYTHON_ALLOWED:
        for node in PYTHON_NODES:
            assert node not in plan, f"{name}: {node}"


def test_bench_log_scan_is_pruned(spark):
    plan = E.queries()["bench_big_log_report"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan and "l_returnflag" in plan
    assert "l_extendedprice" not in plan and "l_comment" not in plan and "l_shipdate" not in plan


def test_flagship_never_materialises_expected_rows(spark):
    plan = E.queries()["a6_report_compact"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # the only Generates are the stand-in answer log's (one per side); the report itself explodes nothing
    assert plan.count("Generate") <= 2
