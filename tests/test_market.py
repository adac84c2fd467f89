"""Captures, prices and the ledger lifecycle."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.functions import odds as O
from asofkit.operators import market as M

T0 = dt.datetime(2024, 5, 1, 9)
CAP = "k int, ts timestamp_ntz, over int, under int, arr long"


def fold(rows):
    """Arrival-order twin of the compaction."""
    st = {}
    for k, ts, o, u, _ in rows:
        two = o is not None and u is not None
        if k not in st:
            st[k] = [(ts, o, u), (ts, o, u, two)]
            continue
        op, cl = st[k]
        if ts < op[0]:
            st[k][0] = (ts, o, u)
        if (ts > cl[0] and (two or not cl[3])) or (ts == cl[0] and two and not cl[3]):
            st[k][1] = (ts, o, u, two)
    return {k: (v[0], v[1][:3]) for k, v in st.items()}


@pytest.mark.parametrize("ordered", [True, False])
def test_compaction_matches_fold(spark, ordered):
    rnd = random.Random(5)
    rows = []
    for a in range(2500):
        rows.append([0 if rnd.random() < 0.3 else rnd.randint(1, 300), T0 + dt.timedelta(minutes=rnd.randint(0, 40)), rnd.choice([None, 110, -120]), rnd.choice([None, 105, -130]), a])
    if ordered:
        rows.sort(key=lambda r: (r[1], r[4]))
        for i, r in enumerate(rows):
            r[4] = i
    df = spark.createDataFrame([tuple(r) for r in rows], CAP)
    got = M.compact_captures(df, ["k"], "ts", "over", "under", "arr", F.floor(F.col("arr") / 100), in_order=ordered).collect()
    want = fold(rows)
    assert len(got) == len(want)
    for r in got:
        assert ((r.open_ts, r.open_over, r.open_under), (r.close_ts, r.close_over, r.close_under)) == want[r.k]


def test_stored_open_stays_blank(spark):
    base = [(1, T0 + dt.timedelta(hours=1), 110, -120, 0, T0, None, -115), (1, T0 + dt.timedelta(hours=2), 115, -125, 1, None, None, None)]
    df = spark.createDataFrame(base, CAP + ", open_ts timestamp_ntz, open_over int, open_under int")
    r = M.compact_captures(df, ["k"], "ts", "over", "under", "arr", F.lit(0)).collect()[0]
    assert (r.open_ts, r.open_over, r.open_under, r.close_over) == (T0, None, -115, 115)


def test_legacy_fold_only_when_strictly_older(spark):
    s = "k int, game int, open_ts timestamp_ntz, open_over int, open_under int, close_ts timestamp_ntz"
    h = lambda n: T0 + dt.timedelta(hours=n)
    df = spark.createDataFrame([
        (1, None, h(0), 1, 1, h(1)), (1, 7, h(2), 2, 2, h(3)),      # folds
        (2, None, h(0), 1, 1, h(2)), (2, 7, h(2), 2, 2, h(3)),      # captured alongside: stays
        (3, None, h(0), 1, 1, h(1)), (3, 7, h(2), 2, 2, h(3)), (3, 8, h(2), 3, 3, h(3)),  # two siblings: stays
    ], s)
    r = {(x.k, x.game): x.open_over for x in M.fold_legacy(df, ["k"], "game").collect()}
    assert r == {(1, 7): 1, (2, None): 1, (2, 7): 2, (3, None): 1, (3, 7): 2, (3, 8): 3}


def test_prices(spark):
    df = spark.createDataFrame([(-110, -110), (-200, 170), (None, 100), (0, 100)], "o int, u int")
    r = df.select(O.no_vig("o", "u").alias("f"), O.shin_no_vig("o", "u").alias("s"), O.american_to_prob("o").alias("p")).collect()
    assert abs(r[0].f - 0.5) < 1e-12 and abs(r[0].s - 0.5) < 1e-12
    assert r[1].s > r[1].f > 0.5  # favourites are shaded up
    assert r[2].f is None and r[3].p is None


def test_consensus_prefers_sharp_book(spark):
    q = spark.createDataFrame([(1, -110, -110, "a"), (1, -150, 130, "Pinnacle"), (1, -105, -115, "c"), (2, -110, -110, "a"), (2, -130, 110, "b"), (3, -110, None, "a")], "k int, o int, u int, book string")
    f = {r.k: r.fair for r in M.consensus_fair(q, ["k"], "o", "u", "book").collect()}
    assert abs(f[1] - 0.6 / (0.6 + 100 / 230)) < 1e-9 and set(f) == {1, 2}


LED = "seq long, d date, game long, entity long, team string, market string, line double, side string, price int, status string, outcome string, stake double, stake_capped_by string, pnl double, bet_key string"
DAY = dt.date(2024, 5, 1)


def bet(seq, **kw):
    r = dict(seq=seq, d=DAY, game=1, entity=10, team="H", market="batter_hits", line=0.5, side="Over", price=100, status="paper", outcome="", stake=1.0, stake_capped_by="", pnl=0.0, bet_key="k1")
    r.update(kw)
    return tuple(r[c.split()[0]] for c in LED.split(", "))


def setup(spark):
    box = spark.createDataFrame([(1, 10, "H", 2, 1, 4), (1, 11, "H", 1, 0, 3), (1, 20, "SO", 6, 1, 0), (1, 21, "SO", 6, 0, 0), (1, 12, "H", 0, 0, 0)], "game long, entity long, stat string, value long, started int, exposure int")
    fin = spark.createDataFrame([(1, "H", "A", 5, 3)], "game long, home string, away string, home_score int, away_score int")
    cfg = spark.createDataFrame([("batter_hits", "player", "H"), ("pitcher_strikeouts", "starter", "SO"), ("totals", "total", None), ("team_totals", "team", None), ("h2h", "side", None)], "market string, scope string, stat string")
    return box, fin, cfg


def test_settlement_rules(spark):
    box, fin, cfg = setup(spark)
    led = spark.createDataFrame([
        bet(1, bet_key="a"), bet(2, bet_key="b", line=2.0), bet(3, bet_key="c", market="pitcher_strikeouts", entity=21, line=4.5), bet(4, bet_key="d", market="pitcher_strikeouts", entity=20, line=6.5, side="Under"),
        bet(5, bet_key="e", market="totals", entity=-1, line=8.0), bet(6, bet_key="f", market="h2h", entity=-1, team="A"), bet(7, bet_key="g", market="team_totals", entity=-1, team="A", line=2.5, price=-200),
        bet(8, bet_key="h", game=99), bet(9, bet_key="i"), bet(10, bet_key="i"), bet(11, bet_key="j", outcome="win", pnl=1.0), bet(12, bet_key="j")], LED)
    s = M.settle(led, box, fin, cfg, F.lit(DAY))
    r = {x.seq: (x.outcome, round(x.pnl, 4)) for x in s.collect()}
    assert r[1] == ("win", 1.0) and r[2] == ("push", 0.0)
    assert r[3] == ("", 0.0)          # relief only: stays open
    assert r[4] == ("win", 1.0) and r[5] == ("push", 0.0) and r[6] == ("lose", -1.0) and r[7] == ("win", 0.5)
    assert r[8] == ("", 0.0)          # no final
    assert r[9][0] == "superseded" and r[10] == ("win", 1.0)   # newest generation only
    assert r[11] == ("win", 1.0) and r[12][0] == "superseded"  # never next to a settled twin
    again = {x.seq: (x.outcome, round(x.pnl, 4)) for x in M.settle(s, box, fin, cfg, F.lit(DAY)).collect()}
    assert again == r


def test_unplayed_rows_void_only_on_earlier_dates(spark):
    box, fin, cfg = setup(spark)
    led = spark.createDataFrame([bet(1, entity=77, bet_key="a"), bet(2, entity=12, bet_key="b"), bet(3, bet_key="c"), bet(4, market="pitcher_strikeouts", entity=21, bet_key="d"), bet(5, entity=77, game=9, bet_key="e")], LED)
    r = {x.seq: x.outcome for x in M.void_unplayed(led, box, fin, cfg, F.lit(DAY + dt.timedelta(days=1))).collect()}
    assert r == {1: "void", 2: "void", 3: "", 4: "void", 5: ""}
    assert {x.outcome for x in M.void_unplayed(led, box, fin, cfg, F.lit(DAY)).collect()} == {""}


def test_append_supersedes_and_respects_settled(spark):
    old = spark.createDataFrame([bet(1, bet_key="a"), bet(2, bet_key="b", outcome="lose", pnl=-1.0), bet(3, bet_key="c", status="track")], LED)
    new = spark.createDataFrame([bet(4, bet_key="a", side="Under"), bet(5, bet_key="b"), bet(6, bet_key="z")], LED)
    out = M.append_superseding(old, new)
    r = sorted((x.seq, x.status, x.outcome) for x in out.collect())
    assert r == [(1, "paper", "superseded"), (1, "void", ""), (2, "paper", "lose"), (3, "track", ""), (4, "paper", ""), (6, "paper", "")]


def test_bet_key_is_side_agnostic(spark):
    df = spark.createDataFrame([("2024-05-01", "777.0", None, "H", "h2h", None, "A@H", "1"), ("2024-05-01", "777", "nan", "A", "h2h", "", "A@H", "2"), ("2024-05-01", None, "5", "H", "hits", "0.50", "A@H", "1")],
                               "d string, game string, entity string, team string, market string, line string, label string, gnum string")
    k = [r[0] for r in M.with_bet_key(df.withColumnRenamed("date", "d")).select("bet_key").collect()]
    assert k[0] == k[1] and k[2] == "2024-05-01||5|H|hits|0.5|A@H|1"


def test_stake_rules_in_order(spark):
    cols = "family string, price int, p_model double, p_close double, books int, bet_key string, seq int"
    df = spark.createDataFrame([("x", 100, .9, .9, 3, "a", 1), ("ok", 100, .52, .52, 3, "b", 2), ("ok", 600, .3, .3, 3, "c", 3), ("ok", 100, .6, .6, 1, "d", 4), ("ok", 100, .7, .7, 3, "e", 5), ("ok", 100, .55, .53, 3, "f", 6), ("ok", 120, .55, .53, 3, "f", 7)], cols)
    p = spark.createDataFrame([("ok",)], "family string")
    r = {x.bet_key: (x.seq, x.status, x.stake_capped_by, round(x.stake, 6)) for x in M.enrich(df, p, "family", 100.0, [F.asc("seq")]).collect()}
    assert r["a"][1:] == ("track", "family-not-PASS", 0.0) and r["b"][2] == "edge<0.03" and r["c"][2] == "longshot-band" and r["d"][2] == "single-book"
    assert r["e"][1:] == ("paper", "per-bet-1%", 1.0)
    assert r["f"][0] == 7  # the better price of one identity
