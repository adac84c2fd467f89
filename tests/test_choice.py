import datetime as dt
import random

from pyspark.sql import functions as F

from asofkit.operators import choice as C

D0 = dt.date(2024, 1, 1)


def test_rested_pool_against_plain_loop(spark):
    rnd = random.Random(3)
    uses = {(g, a, D0 + dt.timedelta(days=i)): (rnd.randint(1, 2), rnd.randint(0, 40), rnd.randint(0, 3)) for g in "xy" for a in range(6) for i in range(120) if rnd.random() < 0.3}
    u = spark.createDataFrame([(g, a, d, *v) for (g, a, d), v in uses.items()], "team string, arm int, d date, n int, np int, sv int")
    choices = spark.createDataFrame([(g, D0 + dt.timedelta(days=i)) for g in "xy" for i in range(0, 130, 3)], "team string, d date")
    got = {(r.team, r.arm, r.d): r for r in C.rested_pool(u, choices, ["team"], "arm", "d", "n", "np", ["sv"], recent=10, history=40)
           .withColumn("ok", C.eligible()).withColumn("tier", C.workload_tier()).collect()}
    want = 0
    for g in "xy":
        for i in range(0, 130, 3):
            day = D0 + dt.timedelta(days=i)
            for a in range(6):
                at = lambda lag: uses.get((g, a, day - dt.timedelta(days=lag)), (0, 0, 0))  # noqa: E731,B023
                recent = sum(at(k)[0] for k in range(1, 11))
                if not recent:
                    assert (g, a, day) not in got
                    continue
                want += 1
                r = got[g, a, day]
                assert (r.n_1, r.n_2, r.load_1, r.load_2, r.n_recent) == (at(1)[0], at(2)[0], at(1)[1], at(2)[1], recent)
                assert (r.n_history, r.sv_history) == (sum(at(k)[0] for k in range(1, 41)), sum(at(k)[2] for k in range(1, 41)))
                assert r.ok == (not (at(1)[0] and at(2)[0]) and at(1)[1] < 25)
                assert r.tier == (2 if at(1)[1] >= 20 or (at(1)[1] and at(2)[1]) else 1 if at(1)[1] >= 10 else 0)
    assert want == len(got) > 100


def test_nth_arm_and_empty(spark):
    rows = spark.createDataFrame([("x", 1, D0, 5), ("x", 2, D0, 3), ("x", 3, D0, 4), ("y", 1, D0, 1)], "team string, arm int, d date, first int")
    assert [(r.team, r.arm) for r in C.nth_arm(rows, ["team"], "d", "arm", "first").collect()] == [("x", 3)]
    none = rows.filter("false").select("team", "arm", "d", F.lit(1).alias("n"), F.lit(1).alias("np"))
    assert C.rested_pool(none, rows.select("team", "d").distinct(), ["team"], "arm", "d", "n", "np", []).count() == 0


def test_every_frame_of_the_pool_only_grows(spark):
    """A sliding frame is summed anew at each row, which costs rows times frame."""
    u = spark.createDataFrame([("x", 1, D0, 1, 5, 0)], "team string, arm int, d date, n int, np int, sv int")
    plan = C.rested_pool(u, u.select("team", "d"), ["team"], "arm", "d", "n", "np", ["sv"])._jdf.queryExecution().optimizedPlan().toString()
    frames = [x.lower() for x in plan.split("specifiedwindowframe(RangeFrame, ")[1:]]
    assert frames and all(x.startswith("unboundedpreceding") for x in frames)
