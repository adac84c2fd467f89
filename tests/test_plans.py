"""Physical plans: pruning, pushdown, no cross joins, no per-row Python."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

from asofkit.registry import load_all  # noqa: E402
from plan_audit import SKIP, facts  # noqa: E402

SF = "/root/testdata/sf0.001"
REG = {n: q for n, q in load_all().items() if q.fn.__module__ not in SKIP}


@pytest.mark.parametrize("name", sorted(REG))
def test_no_cross_join_and_no_row_python(spark, name):
    f = facts(REG[name].fn(spark, SF))
    assert f["cartesian"] == 0 and f["bnlj"] == 0
    assert f["python"] == 0


def test_scan_reads_only_what_it_needs(spark):
    plan = REG["asof_decayed_rate"].fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    li = REG["count_completeness"].fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in li
