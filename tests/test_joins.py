"""Guarded joins against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from asofkit.operators import joins as J

T0 = dt.datetime(2024, 5, 1)


def test_nearest_guarded_matches_brute_force(spark):
    rnd = random.Random(8)
    right = [(rnd.randint(1, 4), i, T0 + dt.timedelta(minutes=rnd.choice([rnd.randint(0, 3000), 10 * rnd.randint(0, 60)]))) for i in range(25)] + [(7, 99, T0)]
    left = [(i, rnd.choice([1, 2, 3, 4, 5, 7]), T0 + dt.timedelta(minutes=rnd.randint(-600, 3600))) for i in range(300)]
    got = {r.lid: r.rid_match for r in J.nearest_guarded(spark.createDataFrame(left, "lid int, k int, ts timestamp_ntz"), spark.createDataFrame(right, "k int, rid long, rts timestamp_ntz"),
                                                         ["k"], "lid", "ts", "rts", "rid").collect()}
    for i, k, ts in left:
        g = sorted((abs((t - ts).total_seconds()), rid) for kk, rid, t in right if kk == k)
        want = None
        if len(g) == 1:
            want = g[0][1] if g[0][0] <= 6 * 3600 else None
        elif g and g[0][0] + 300 < g[1][0]:
            want = g[0][1]
        assert got[i] == want, (i, k, g[:2])


def test_resolution_never_guesses(spark):
    idx = spark.createDataFrame([(1, "BAL", "Ryan O'Hearn"), (2, "SEA", "Cal Raleigh"), (3, "SEA", "Luke Raley"), (4, "NYY", "Will Smith"), (5, "LAD", "Will Smith"), (6, "HOU", "J.T. Foo"), (7, "SEA", "Carl Raleigh")],
                                "entity int, team string, name string")
    asks = spark.createDataFrame([(1, "BAL", "ryan-ohearn"), (2, "SEA", "lucas-raley"), (3, "SEA", "caleb-raleigh"), (4, "LAD", "will-smith-c"), (5, "XXX", "Will Smith"), (6, "XXX", "jt-foo"), (7, "SEA", "")], "id int, team string, name string")
    r = {x.id: (x.entity, x.tier) for x in J.resolve_entities(asks, idx, "id", "team", "name", "entity").collect()}
    assert r == {1: (1, "team_collapsed"), 2: (3, "initial"), 3: (None, None), 4: (5, "exact"), 5: (None, None), 6: (6, "collapsed"), 7: (None, None)}


def test_ordinal_pair_refuses_unequal_counts(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "k string, o int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("b", 10, "z")], "k string, r int, v string")
    r = {(x.k, x.o): (x.status, x.v) for x in J.ordinal_pair(left, right, ["k"], ["o"], ["r"], F.lit(0), F.lit(0), ["v"]).collect()}
    assert r == {("a", 1): ("paired", "x"), ("a", 2): ("paired", "y"), ("b", 1): ("unequal", None), ("b", 2): ("unequal", None), ("c", 1): ("no_right", None)}


def test_interval_edges(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    pts = spark.createDataFrame([(1, d(n)) for n in (0, 5, 40, 70, 200)] + [(2, d(300))], "e int, d date")
    iv = spark.createDataFrame([(1, d(5), d(70)), (2, d(1), None)], "e int, s date, t date")
    r = {(x.e, x.d): x.active_since is not None for x in J.interval_active(pts, iv, ["e"], "d", "s", "t").collect()}
    assert r == {(1, d(0)): False, (1, d(5)): True, (1, d(40)): True, (1, d(70)): False, (1, d(200)): False, (2, d(300)): True}


def test_fallback_guard(spark):
    dim = spark.createDataFrame([("a", 1, 10), ("a", None, 11), ("b", None, 20), ("c", None, 30)], "k string, g int, v int")
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", 6), ("c", 7)], "k string, g int")
    r = {(x.k, x.g): (x.v, x.v_via) for x in J.fallback_lookup(left, dim, ["k"], "g", "v").collect()}
    assert r == {("a", 1): (10, "exact"), ("a", 2): (None, None), ("b", 5): (20, "sentinel"), ("c", 6): (None, None), ("c", 7): (None, None)}
