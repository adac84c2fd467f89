"""As-of joins against a brute-force twin; leakage and decay rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators.asof import asof_join, asof_time_join, audit_leakage, decayed_panel, multi_panel_asof

D0 = dt.date(2020, 1, 1)


def data(spark, seed=3):
    rnd = random.Random(seed)
    left = [(i, rnd.choice([None, 1, 2, 3, 9]), D0 + dt.timedelta(days=rnd.randint(0, 60))) for i in range(200)]
    pan = {}
    for _ in range(60):
        pan[(rnd.randint(1, 3), D0 + dt.timedelta(days=rnd.randint(0, 60)))] = float(rnd.randint(1, 100))
    L = spark.createDataFrame(left, "id int, e int, d date")
    Pn = spark.createDataFrame([(k[0], k[1], v) for k, v in pan.items()], "e int, d date, x double")
    return left, pan, L, Pn


def brute(left, pan, strict, back, tol=None):
    out = {}
    for i, e, d in left:
        c = [(pd, v) for (pe, pd), v in pan.items() if pe == e and ((pd < d if strict else pd <= d) if back else (pd > d if strict else pd >= d))]
        hit = (max(c) if back else min(c)) if c else None
        if hit and tol is not None and abs((hit[0] - d).days) > tol:
            hit = None
        out[i] = hit
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize("strategy", ["window", "range"])
def test_asof_matches_brute_force(spark, strict, back, strategy):
    left, pan, L, Pn = data(spark)
    got = asof_join(L, Pn, ["e"], ["x"], strict=strict, direction="backward" if back else "forward", match_date="m", strategy=strategy).collect()
    want = brute(left, pan, strict, back)
    for r in got:
        assert ((r.m, r.x) if r.m else None) == want[r.id]


def test_tolerance(spark):
    left, pan, L, Pn = data(spark)
    want = brute(left, pan, False, False, 3)
    for r in asof_join(L, Pn, ["e"], ["x"], strict=False, direction="forward", tolerance_days=3, match_date="m").collect():
        assert ((r.m, r.x) if r.m else None) == want[r.id]


def test_future_rows_change_nothing(spark):
    left, pan, L, Pn = data(spark)
    cut = D0 + dt.timedelta(days=30)
    past = L.filter(F.col("d") <= cut)
    daily = Pn.withColumnRenamed("x", "n")
    feats = lambda dd: sorted(map(tuple, asof_join(past, decayed_panel(dd, ["e"], ["n"], 10.0), ["e"], ["n_d"], half_life=10.0).collect()), key=str)
    assert feats(daily) == feats(daily.filter(F.col("d") <= cut))


def test_decay_value(spark):
    daily = spark.createDataFrame([(1, D0, 8.0), (1, D0 + dt.timedelta(days=10), 4.0)], "e int, d date, n double")
    p = {r.d: r.n_d for r in decayed_panel(daily, ["e"], ["n"], 10.0).collect()}
    assert p[D0] == 8.0 and abs(p[D0 + dt.timedelta(days=10)] - 8.0) < 1e-9
    left = spark.createDataFrame([(1, D0 + dt.timedelta(days=30)), (2, D0)], "e int, d date")
    got = {r.e: r.n_d for r in asof_join(left, decayed_panel(daily, ["e"], ["n"], 10.0), ["e"], ["n_d"], half_life=10.0).collect()}
    assert abs(got[1] - 2.0) < 1e-9 and got[2] is None


def test_multi_panel_equals_single_joins(spark):
    _, _, L, Pn = data(spark)
    d = Pn.withColumnRenamed("x", "n")
    ps = {h: (decayed_panel(d, ["e"], ["n"], hl), ["n_d"], hl) for h, hl in (("a", 5.0), ("b", 50.0))}
    m = {r.id: (r.a_n_d, r.b_n_d) for r in multi_panel_asof(L, ["e"], ps).collect()}
    for i, h in enumerate(("a", "b")):
        one = {r.id: r.n_d for r in asof_join(L, ps[h][0], ["e"], ["n_d"], half_life=ps[h][2]).collect()}
        for k in one:
            assert (one[k] is None and m[k][i] is None) or abs(one[k] - m[k][i]) < 1e-12


def test_time_grain_and_audit(spark):
    t = dt.datetime(2020, 1, 1, 12)
    left = spark.createDataFrame([(1, 1, t), (2, 1, t + dt.timedelta(days=5)), (3, 2, t)], "id int, e int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, t, 5), (1, t + dt.timedelta(days=1), 6)], "e int, ts timestamp_ntz, v int")
    inc = {r.id: r.v for r in asof_time_join(left, right, ["e"], ["v"], strict=False).collect()}
    exc = {r.id: r.v for r in asof_time_join(left, right, ["e"], ["v"], strict=True).collect()}
    assert inc == {1: 5, 2: 6, 3: None} and exc == {1: None, 2: 6, 3: None}
    bad = spark.createDataFrame([(D0, D0), (D0, None), (D0, D0 - dt.timedelta(days=1))], "d date, m date")
    r = audit_leakage(bad, "d", "m").collect()[0]
    assert (r.n_rows, r.n_no_history, r.n_leaks) == (3, 1, 1)
