"""State machines: stints and runs of days."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from asofkit.operators.windows import date_runs, last_n_form, stints
from asofkit.streaming.stateful import islands, walk

D0 = dt.date(2024, 1, 1)


def test_stints_match_the_state_machine(spark):
    rnd = random.Random(6)
    ev = [(0 if rnd.random() < 0.3 else rnd.randint(1, 40), D0 + dt.timedelta(days=rnd.randint(0, 30)), i, rnd.choice(["place", "transfer", "activate", "rehab"]), rnd.choice([None, 10, 60])) for i in range(900)]
    want = []
    for p in {e[0] for e in ev}:
        cur = None
        for _, d, i, k, days in sorted((e for e in ev if e[0] == p), key=lambda e: (e[1], e[2])):
            if k in ("place", "transfer"):
                cur = cur or [p, d, None, 0, 0]
                cur[3] = max(cur[3], int((days or 0) >= 60))
            elif k == "rehab" and cur:
                cur[4] = 1
            elif k == "activate" and cur:
                cur[2] = d
                want.append(tuple(cur))
                cur = None
        if cur:
            want.append(tuple(cur))
    df = spark.createDataFrame(ev, "p int, d date, i int, kind string, days int")
    got = [(r.p, r.place_date, r.act_date, r.il60, r.rehab) for r in stints(df, "p", "d", F.col("i"), "kind", "days").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_islands_carry_over_batches():
    """Feeding the events in pieces, with the open island leading the next piece, gives the stints of one pass."""
    rnd = random.Random(3)
    for _ in range(60):
        ev = pd.DataFrame([(D0 + dt.timedelta(days=i), rnd.choice(["place", "transfer", "activate", "rehab"]), rnd.choice([None, 10, 60])) for i in range(25)], columns=["d", "kind", "k"])
        cols = ["place_date", "act_date", "il60", "rehab"]
        whole = islands(ev)[cols].astype(object).where(lambda x: x.notna(), None).values.tolist()
        got, lead = [], []
        for at in range(0, 25, 7):
            out = islands(pd.concat([pd.DataFrame(lead, columns=["d", "kind", "k"]), ev[at : at + 7]]) if lead else ev[at : at + 7])
            out = out[cols].astype(object).where(lambda x: x.notna(), None).values.tolist()
            got += [x for x in out if x[1] is not None]
            left = [x for x in out if x[1] is None]
            lead = [(left[0][0], "place", 60 if left[0][2] else 0)] + [(left[0][0], "rehab", 0)] * left[0][3] if left else []
        assert got + left == whole


def test_walk_in_pieces_is_the_frame_form():
    """The walk of the keyed state, fed in pieces with what it left open, gives the stints of the frames."""
    rnd = random.Random(5)
    for _ in range(60):
        ev = [(D0 + dt.timedelta(days=i), rnd.choice(["place", "transfer", "activate", "rehab"]), rnd.choice([None, 10, 60])) for i in range(25)]
        whole = islands(pd.DataFrame(ev, columns=["d", "kind", "k"]))[["place_date", "act_date", "il60", "rehab"]].astype(object)
        got, held = [], None
        for at in range(0, 25, 7):
            done, held = walk(held, ev[at : at + 7])
            got += done
        got += [(held[0], None, *held[1:])] if held else []
        assert got == [tuple(x) for x in whole.where(whole.notna(), None).values.tolist()]


def test_last_n_ignores_the_same_day(spark):
    df = spark.createDataFrame([(1, 2024, D0, 1, 10.0), (1, 2024, D0, 2, 20.0), (1, 2024, D0 + dt.timedelta(days=1), 3, 30.0), (1, 2024, D0 + dt.timedelta(days=2), 4, 0.0), (1, 2025, D0 + dt.timedelta(days=400), 5, 0.0)],
                               "team int, season int, d date, game int, v double")
    r = {x.game: x.v_last2 for x in last_n_form(df, "team", "season", "d", ["game"], ["v"], 2).collect()}
    assert r == {1: None, 2: None, 3: 15.0, 4: 25.0, 5: None}


def test_date_runs(spark):
    df = spark.createDataFrame([(1, D0 + dt.timedelta(days=n)) for n in (0, 1, 3, 10, 11)], "k int, d date")
    assert sorted((r.n_days for r in date_runs(df, ["k"], "d", 2).collect())) == [2, 3]
