"""Plan lint for every registered query of the library: no cartesian products, no
nested-loop joins, no Python evaluation, and windows only where their input
is partitioned or already bounded by a limit."""
import contextlib
import io

import pytest

import __spark_entry__ as E
from strata.registry import QUERIES

from conftest import SF

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]
# queries whose window is the feature (SQL text; the as-of merge, whose
# groups are a key's time bins) or runs over <= 20 rows
WINDOW_OK = {"sql_window", "chart_auto", "chart_auto_record", "as_of_join"}


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


#: The corpus queries have a lint of their own beside them: their bounded
#: windows and their Python operators are part of the design there.
LIBRARY = [*QUERIES, "flagship_revenue_by_priority"]


@pytest.mark.parametrize("name", LIBRARY)
def test_plan_is_scalable(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"
    if name not in WINDOW_OK:
        assert "Window " not in plan and "WindowGroupLimit" not in plan, f"{name}: window in plan"


def test_scan_pruning(spark):
    plan = _plan(E.queries()["chart_bar"](spark, SF))
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in plan
    plan = _plan(E.queries()["sql_filter_sort"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus), GreaterThan(o_totalprice,200000.0), EqualTo(o_orderstatus,F)]" in plan
