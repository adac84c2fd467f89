"""Statistical identities of the evaluation operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import evaluation as E
from asofkit.operators.shrink import mom_sample_size, prior_factors

SCH = "game long, d date, family string, market string, p double, y int, entity long"


def ledger(spark, n=2400, seed=4, shade=0.0, days=30):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.random()
        y = int(rnd.random() < t)
        z = math.log(max(t, 1e-3) / max(1 - t, 1e-3)) + shade
        out.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i % days), "f", "m", 1 / (1 + math.exp(-z)), y, 1))
    return spark.createDataFrame(out, SCH)


def test_identical_ledgers_tie_and_a_shaded_one_loses(spark):
    a, b = ledger(spark), ledger(spark, shade=1.0)
    key = ["game", "market", "entity"]
    same = {r.family: r for r in E.ab_report(E.pair_ledgers(a, a, key), 80).collect()}
    assert same["f"].verdict == "TIE" and same["f"].delta == 0 and same["f"].p_raw == 1.0
    assert {r.family: r.verdict for r in E.ab_report(E.pair_ledgers(b, a, key), 80).collect()}["f"] == "B BETTER"
    assert {r.family: r.verdict for r in E.ab_report(E.pair_ledgers(a, b, key), 80).collect()}["f"] == "A BETTER"
    thin = E.ab_report(E.pair_ledgers(b.filter("game < 700"), a, key), 40).filter("family = 'f'").collect()[0]
    assert thin.verdict == "INSUFFICIENT n"


def test_disputed_outcomes_drop_out(spark):
    a = ledger(spark, 100)
    b = a.withColumn("y", F.when(F.col("game") < 10, 1 - F.col("y")).otherwise(F.col("y")))
    assert E.pair_ledgers(a, b, ["game", "market", "entity"]).count() == 90


def test_perfect_and_random_ranking(spark):
    rnd = random.Random(1)
    rows, rnd_rows = [], []
    for d in range(20):
        for i in range(20):
            y = int(i < 6)
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            rows.append((d * 20 + i, day, "f", "perfect", 0.9 - i / 50, y, i))
            rnd_rows.append((d * 20 + i, day, "f", "random", rnd.random(), y, i))
    led = spark.createDataFrame(rows + rnd_rows, SCH)
    r = {x.market: x for x in E.goal_board(led, ["market"], "d", [F.asc("game")], reps=60).collect()}
    assert r["perfect"].auc == 1.0 and r["perfect"].t1_hit == 1.0 and r["perfect"].trust_depth >= 6
    assert abs(r["random"].auc - 0.5) < 0.1 and r["random"].trust_depth <= 2


def test_auc_and_ece_by_hand(spark):
    df = spark.createDataFrame([("g", .1, 0), ("g", .4, 0), ("g", .35, 1), ("g", .8, 1), ("g", .4, 1)], "g string, p double, y int")
    assert abs(E.auc(E.value_counts(df, ["g"]), ["g"]).collect()[0].auc - (1 + 1 + 1 + 0 + 1 + 0.5) / 6) < 1e-12
    flat = spark.createDataFrame([("g", 0.5, i % 2) for i in range(40)], "g string, p double, y int")
    assert E.ece(flat, ["g"]).collect()[0].ece == 0.0


def test_all_ones_weights_equal_plain_metrics(spark):
    led = ledger(spark, 600)
    c = E.value_counts(led, ["family"])
    assert abs(E.weighted_ece(c, ["family"]).collect()[0].ece - E.ece(led, ["family"]).collect()[0].ece) < 0.02


def test_bh_monotone(spark):
    r = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9), ("d", 0.03)], "f string, p double")
    got = {x.f: round(x.q, 6) for x in E.bh_adjust(r, "p", "f", "q").collect()}
    assert got == {"a": 0.04, "b": 0.04, "d": 0.04, "c": 0.9}


def test_platt_recovers_a_shift_and_falls_back(spark):
    led = ledger(spark, 6000, shade=0.8)
    ab = E.platt_maps(led, ["family"], 500).collect()[0]
    assert abs(ab.a + 0.8 * ab.b) < 0.2 and abs(ab.b - 1) < 0.15
    assert E.platt_maps(led.limit(100), ["family"], 500).count() == 0
    assert E.platt_maps(led.withColumn("y", F.lit(1)), ["family"], 500).count() == 0
    x = E.crossfit_calibration(led.limit(200), "family", "d")
    assert x.filter(F.abs(F.col("p_cal") - F.col("p")) > 1e-9).count() == 0


def test_mom_is_clipped(spark):
    df = spark.createDataFrame([(400, 0.3), (400, 0.3), (500, 0.3)], "n int, K double")
    assert mom_sample_size(df, "n", ["K"]).collect()[0].k == 2000.0


def test_prior_factors_use_only_earlier_seasons(spark):
    rows = [("v", 2000, 100, 20), ("v", 2001, 100, 90), ("w", 2000, 100, 40), ("w", 2001, 100, 10)]
    df = spark.createDataFrame(rows, "g string, season int, n int, c int")
    f = lambda d: {(r.g, r.year): round(r.f_c, 9) for r in prior_factors(d, ["g"], [], "season", ["c"], "n", 100.0, 3).collect()}
    full, cut = f(df), f(df.filter("season = 2000"))
    assert full[("v", 2001)] == cut[("v", 2001)] == round(1 + 0.5 * (0.2 / 0.3 - 1), 9)
    assert ("v", 2002) in full and ("v", 2000) not in full


def test_resampled_cells_are_placed_before_the_replicates_multiply_them(spark):
    """Crowded and spread values against plain weighted AUC and ECE; no exchange above the join that multiplies rows by replicates."""
    r = random.Random(8)
    rows = [(f, d, r.choice([0.5, 0.501, 0.502, round(r.random(), 3)]), r.random() < 0.4) for f in "ab" for d in range(6) for _ in range(300)]
    led = spark.createDataFrame([(f, d, p, int(y)) for f, d, p, y in rows], "family string, d int, p double, y int")
    draws = [(f, rep, d, r.randint(1, 3)) for f in "ab" for rep in (1, 2, 3) for d in range(6) if r.random() < 0.7]
    w = spark.createDataFrame(draws, "family string, rep int, d int, w long")
    counts, w = E.cut_lineage(E.value_counts(led, ["family", "d"])), E.cut_lineage(w.coalesce(1))
    cells = E.resampled_cells(counts, w, ["family"], "d")
    got = {(x.family, x.rep): x for x in E.auc_and_ece(cells, ["family", "rep"]).collect()}
    assert len(got) == 6
    for (fam, rep), x in got.items():
        wt = {d: n for f, q, d, n in draws if (f, q) == (fam, rep)}
        mine = sorted((p, y, wt[d]) for f, d, p, y in rows if f == fam and d in wt)
        pos, neg = [(p, n) for p, y, n in mine if y], [(p, n) for p, y, n in mine if not y]
        area = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg)
        assert x.auc == pytest.approx(area / (sum(a for _, a in pos) * sum(b for _, b in neg)))
        total, bins = sum(n for _, _, n in mine), {}
        for p in {m[0] for m in mine}:
            upto = sum(n for q, _, n in mine if q <= p)
            b = bins.setdefault(min(10 * upto // total, 9), [0.0, 0])
            b[0] += sum(n * q for q, _, n in mine if q == p)
            b[1] += sum(n * y for q, y, n in mine if q == p)
        assert x.ece == pytest.approx(sum(abs(a - b) for a, b in bins.values()) / total)
    plans, real = [], E.cut_lineage
    E.cut_lineage = lambda df: plans.append(df) or df
    try:
        E.resampled_cells(counts, w, ["family"], "d")
    finally:
        E.cut_lineage = real
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")
