"""What a query shuffles and computes per row: rows not widened before a shuffle, steps not repeated."""

import re

from asofkit.registry import load_all

SF = "/root/testdata/sf0.001"


def plan(spark, name, kind="executedPlan"):
    return getattr(load_all()[name].fn(spark, SF)._jdf.queryExecution(), kind)().toString().split("== Initial Plan ==")[0]


def test_sums_are_taken_behind_the_shuffle(spark):
    p = plan(spark, "sufficient_statistics")
    exchange = p.index("Exchange hashpartitioning")
    assert len(re.findall("Exchange hash", p)) == 1 and p.rindex("HashAggregate") < exchange


def test_outcome_sides_are_computed_once(spark):
    assert plan(spark, "odds_prop_rows", "optimizedPlan").count("lower(") <= 2


def test_hazard_cells_are_a_table(spark, monkeypatch):
    from asofkit.plans import hazard

    calls, real = [], hazard.G.fit_logistic
    monkeypatch.setattr(hazard.G, "fit_logistic", lambda cells, *a: calls.append(cells._jdf.queryExecution().optimizedPlan().toString()) or real(cells, *a))
    hazard.removal_hazard(spark, SF)
    assert len(calls) == 1 and "Aggregate" not in calls[0] and "Join" not in calls[0]
