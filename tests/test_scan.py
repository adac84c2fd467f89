"""Chunked scans equal the plain window, hot keys and NULLs included."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.operators.ranking import global_rank
from asofkit.operators.scan import (
    Carry, Following, Index, Previous, Running, RunningMin, Total, exact_quantiles, group_totals, ordered_scan, top_k,
)


def rows(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        k = 0 if rnd.random() < 0.4 else (None if rnd.random() < 0.02 else rnd.randint(1, 20))  # one hot key, some NULL
        data.append((i, k, rnd.randint(0, 200), None if rnd.random() < 0.3 else rnd.randint(-50, 50)))
    return spark.createDataFrame(data, "id long, k int, t int, v int")


def test_ordered_scan_equals_plain_window(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    got = ordered_scan(df, ["k"], ["t", "id"], F.floor(F.col("t") / 17), [
        Running("run", F.coalesce("v", F.lit(0))), Running("ex", F.coalesce("v", F.lit(0)), inclusive=False), Index("i"), Previous("prev", F.col("v")),
        Following("next", F.col("v")), Carry("carry", F.col("v")), Carry("carry_ex", F.col("v"), inclusive=False), RunningMin("mn", F.col("v")),
        Total("tot", F.coalesce("v", F.lit(0)))])
    v0 = F.coalesce("v", F.lit(0))
    want = df.select(
        "*", F.sum(v0).over(upto).alias("run"), F.coalesce(F.sum(v0).over(before), F.lit(0)).alias("ex"), F.row_number().over(w).cast("long").alias("i"),
        F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("next"), F.last("v", True).over(upto).alias("carry"), F.last("v", True).over(before).alias("carry_ex"),
        F.min("v").over(upto).alias("mn"), F.sum(v0).over(Window.partitionBy("k")).alias("tot"))
    cols = want.columns
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_scan_does_not_depend_on_partitioning(spark):
    df = rows(spark)
    run = lambda d: sorted(map(tuple, ordered_scan(d, ["k"], ["t", "id"], F.floor(F.col("t") / 50), [Running("r", F.coalesce("v", F.lit(0))), Index("i")]).collect()), key=str)
    assert run(df.repartition(1)) == run(df.repartition(7)) == run(df.orderBy(F.rand(3)))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(int(rng.integers(0, 3)), float(np.round(rng.random(), 3))) for _ in range(2000)]
    df = spark.createDataFrame(data, "g int, p double")
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "p", [0.0, 0.1, 0.5, 0.93, 1.0], F.floor(F.col("p") * 64)).collect()}
    for g in range(3):
        vals = [p for k, p in data if k == g]
        for q in (0.0, 0.1, 0.5, 0.93, 1.0):
            assert abs(got[(g, q)] - np.quantile(vals, q)) < 1e-9
    whole = {r.prob: r.quantile for r in exact_quantiles(df, [], "p", [0.25], F.floor(F.col("p") * 64)).collect()}
    assert abs(whole[0.25] - np.quantile([p for _, p in data], 0.25)) < 1e-9


def test_global_rank(spark):
    df = rows(spark, 500)
    got = {r.id: r.pos for r in global_rank(df, [F.col("t"), F.col("id")], F.floor(F.col("t") / 9), "pos").collect()}
    want = {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.t, r.id)))}
    assert got == want


def test_top_k_is_limited_before_the_shuffle(spark):
    df = top_k(rows(spark), ["k"], [F.desc("t"), F.asc("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_group_totals_without_keys(spark):
    df = spark.range(10)
    assert group_totals(df, [], s=F.sum("id")).select("s").distinct().collect()[0].s == 45
