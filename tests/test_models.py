"""Fits read rows that are joined once, whatever the number of folds, seeds and passes."""

from pyspark.sql import functions as F

from asofkit.operators import evaluation as E
from asofkit.operators import learn as M
from asofkit.plans import models

SF = "/root/testdata/sf0.001"


def test_training_rows_are_a_table(spark):
    plan = models.training_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_maps_of_all_folds_settle_together(spark, monkeypatch):
    calls, real = [], E.platt_maps
    monkeypatch.setattr(E, "platt_maps", lambda led, keys, least: calls.append(keys) or real(led, keys, least))
    r = {x.fold: x.n for x in models.walk_forward(spark, SF).collect()}
    assert calls == [["fold"]]
    want = {x.season: x["count"] for x in models.training_rows(spark, SF).groupBy("season").count().collect()}
    assert all(r[f] == want[f] for f in (1998, 1999, 2000, 2001) if f in want)


def test_bagged_members_share_their_stages(spark, monkeypatch):
    calls, real = [], M.feature_stages
    monkeypatch.setattr(M, "feature_stages", lambda *a: calls.append(a) or real(*a))
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    b = M.bagged(rows.filter("id < 300"), rows.filter("id >= 300"), ["x"], "y", [1, 2], "forest", numTrees=3, maxDepth=2)
    assert b.columns == ["id", "x", "y", "members", "p"] and b.count() == 100 and len(calls) == 1
    assert all(len(r.members) == 2 and abs(sum(r.p) - 1) < 1e-9 for r in b.collect())
