import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.operators.settlement import settle_sheet

D = dt.date(2024, 6, 1)
BOX = "game long, d date, entity long, h long, b2 long, b3 long, hr long, tb long, r long, rbi long, bb long, sb long"
PIT = "game long, d date, entity long, started int, so long, outs long, h long, bb long, er long"


def settled(spark, rows, finals=((1, "A@B", 1, 5, 3),)):
    sheet = spark.createDataFrame([(i, D, *r) for i, r in enumerate(rows)], "i int, d date, matchup string, gamepk long, gnum int, prop string, side string, line double, team string, entity long")
    bat = spark.createDataFrame([(1, D, 7, 2, 1, 0, 0, 3, 1, 2, 1, 0), (2, D, 7, 4, 0, 0, 2, 10, 2, 4, 0, 0)], BOX)
    pit = spark.createDataFrame([(1, D, 9, 1, 6, 17, 5, 2, 3), (1, D, 8, 0, 2, 3, 1, 0, 0)], PIT)
    fin = spark.createDataFrame([(g, D, m, s, "B", "A", h, a) for g, m, s, h, a in finals], "game long, d date, matchup string, start int, home string, away string, home_score int, away_score int")
    return [r.result for r in settle_sheet(sheet, bat, pit, fin).orderBy("i").collect()]


def test_all_labels_over_under_and_push(spark):
    pit = {"strikeouts": 6, "outs": 17, "hits allowed": 5, "walks": 2, "earned runs": 3}
    bat = {"HR": 0, "hits": 2, "total bases": 3, "RBIs": 2, "runs": 1, "singles": 1, "doubles": 1, "walks": 1, "stolen bases": 0, "H+R+RBI": 5}
    rows = []
    for who, labels in ((9, {f"pitcher {k}": v for k, v in pit.items()}), (7, bat)):
        for k, v in labels.items():
            rows += [("A@B", 1, None, f"{k} o{v - 0.5}", s, line, None, who) for s, line in (("Over", v - 0.5), ("Under", v - 0.5), ("Over", float(v)))]
    assert settled(spark, rows) == ["win", "lose", "push"] * 15


def test_games_voids_and_open_rows(spark):
    rows = [
        ("A@B", 1, None, "moneyline", "B", None, None, None), ("A@B", 1, None, "moneyline", "A", None, None, None),
        ("A@B", 1, None, "total runs", "Under", 8.0, None, None), ("A@B", 1, None, "team total runs", "Over", 4.5, "B", None), ("A@B", 1, None, "team total runs", "Over", 3.5, "A", None),
        ("A@B", 5, None, "hits o0.5", "Over", 0.5, None, 7),  # its own game is not final
        ("A@B", 1, None, "hits o0.5", "Over", 0.5, None, 77),  # did not play
        ("A@B", 1, None, "pitcher outs o0.5", "Over", 0.5, None, 8),  # relief only
        ("A@B", 1, None, "pitcher quality starts o0.5", "Over", 0.5, None, 9), ("A@B", 1, None, "hits o0.5", "Over", 0.5, None, None), ("A@B", 1, None, "hits o0.5", "Over", None, None, 7),
    ]
    assert settled(spark, rows) == ["win", "lose", "push", "win", "lose", "open", "void", "void", "open", "open", "open"]


def test_double_headers_wait_until_the_finals_cover_the_day(spark):
    row = lambda gnum: ("A@B", None, gnum, "hits o2.5", "Over", 2.5, None, 7)
    one, two = ((1, "A@B", 1, 5, 3),), ((1, "A@B", 1, 5, 3), (2, "A@B", 2, 1, 0))
    assert settled(spark, [row(1), row(2)], one) == ["open", "open"]  # the lone final could be either game
    assert settled(spark, [row(1), row(2)], two) == ["lose", "win"]
    assert settled(spark, [row(None)], two) == ["open"]
    assert settled(spark, [row(None)], one) == ["lose"]


def test_ledger_voids_what_has_no_answer(spark):
    from asofkit.operators.ledger import graded, priced

    bat = spark.createDataFrame([(1, D, 7, 4, 2, 1, 0, 0, 3, 1, 2, 1, 0, 1), (1, D, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)], "game long, d date, entity long, pa long, h long, b2 long, b3 long, hr long, tb long, r long, rbi long, bb long, sb long, so long")
    pit = spark.createDataFrame([(1, D, 9, 1, 6, 17, 5, 2, 3), (1, D, 8, 0, 2, 3, 1, 0, 0)], PIT)
    fin = spark.createDataFrame([(1, D, "B", "A", 5, 3), (2, D, "B", "A", None, None)], "game long, d date, home string, away string, home_score int, away_score int")
    lines = {"pk": (5.5, 6.0), "pout": (16.5,), "pha": (4.5,), "pbb": (2.5,), "per": (2.5,), "tot": (7.5,), "tt": (3.5,)}
    got = {(r.who, r.market): r.y for r in graded(bat, pit, fin, lines).collect()}
    assert len(got) == 21 + 6 + 4 and not {w for w, _ in got} & {"6", "8"}
    assert [got[("7", m)] for m in ("HR", "2+ Hits", "Single", "3+ TB", "H+R+RBI 4+", "SB", "K", "2+ K")] == [0, 1, 1, 1, 1, 0, 1, 0]
    assert [got[("9", m)] for m in ("K > 5.5", "K > 6.0", "Outs > 16.5", "BB > 2.5", "ER > 2.5")] == [1, 0, 1, 0, 1]
    assert [got[("B", m)] for m in ("home ML", "Runs > 7.5", "Home Runs > 3.5")] == [1, 1, 1] and got[("A", "Away Runs > 3.5")] == 0
    p = {(r.d, r.who): r.p for r in priced(spark.createDataFrame([("m", "a", D, 1), ("m", "b", D, 0), ("m", "a", dt.date(2024, 6, 2), 1)], "market string, who string, d date, y int")).collect()}
    assert p[(D, "a")] == 0.5 and p[(dt.date(2024, 6, 2), "a")] == (1 + 20 * 0.5) / 21


def test_ledger_totals_equal_priced_rows_and_never_shuffle_single_markets(spark):
    from pyspark.sql import functions as F

    from asofkit.operators.ledger import graded, graded_totals, priced
    from asofkit.plans.settlement import LINES, boxes, graded_ledger_loss, slate

    sf = "/root/testdata/sf0.001"
    bat, pit = boxes(spark, sf)
    holes = bat.withColumn("entity", F.when(F.col("entity") % 7 != 0, F.col("entity"))).withColumn("r", F.when(F.col("entity") % 5 != 0, F.col("r")))
    p, y = F.col("p"), F.col("y")
    want = priced(graded(holes, pit, slate(spark, sf), LINES)).groupBy("family", "market", "who").agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("known"), F.sum("y").alias("hits"), F.round(F.sum("p"), 5).alias("expected"), F.round(F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 5).alias("loss"))
    got = graded_totals(holes, pit, slate(spark, sf), LINES).withColumns({c: F.round(c, 5) for c in ("expected", "loss")}).select(want.columns)
    got, want = ({tuple(r)[:3]: tuple(r)[3:] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(g == pytest.approx(w, abs=2e-5) for g, w in ((got[k], want[k]) for k in got))
    # markets become rows only above the shuffles of lines and days: at most the totals by market move after it
    plan = graded_ledger_loss(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for i, x in enumerate(plan) if "Join" in x and any("Generate explode" in z and z.index("Generate") > x.index("Join") for z in plan[i:])]


def test_rows_without_a_final_are_spread(spark):
    """Rows meet the finals by (game, day, matchup): by game alone, all rows without a final would share one task."""
    from asofkit.plans.settlement import boxes, sheet, slate

    sf = "/root/testdata/sf0.001"
    bat, pit = boxes(spark, sf)
    plan = settle_sheet(sheet(spark, sf), bat, pit, slate(spark, sf).filter("home_score IS NOT NULL"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join LeftOuter" in x and "final_game" in x]
    alone = [x for x in joins if " AND " not in x and " && " not in x]
    assert len(alone) == 2 and any("matchup" in x for x in joins)  # the two of finals and boxes


def test_rows_are_placed_twice_and_narrow(spark):
    """Once by what names their game and once by day and entity, without their label's text; lines are placed once."""
    from asofkit.plans.settlement import boxes, sheet, slate

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = sheet(spark, sf).withColumn("mark", F.lit("x").cast("string")).localCheckpoint()
        tables = [x.localCheckpoint() for x in (*boxes(spark, sf), slate(spark, sf).filter("home_score IS NOT NULL"))]
        got = settle_sheet(given, *tables).select("mark", "actual", "result")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 11
        wide = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum("Join LeftOuter" in x and ("matchup" in x or "entity" in x) for x in wide) <= 3  # and the counts of games
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_several_games_a_day_and_odd_ordinals(spark):
    """A row takes its own game's line though its player has another that day; ordinals below one, and rows without a day, name no game."""
    day = lambda m, g, k, w: (m, g, k, "hits o2.5", "Over", 2.5, None, w)
    rows = [day("A@B", 1, None, 7), day("A@B", 2, None, 7), day("C@D", 2, None, 7), day("A@B", None, 0, 7), day("A@B", None, -1, 7), day("A@B", None, None, 7)]
    assert settled(spark, rows, ((1, "A@B", 1, 5, 3), (2, "C@D", 1, 1, 0))) == ["lose", "open", "win", "open", "open", "lose"]
    assert settled(spark, [day(None, 1, None, 7)]) == []
    other = [("E@F", 3, None, "hits o5.5", s, 5.5, None, 7) for s in ("Over", "Under")]  # no line in this game, two elsewhere that day: their sum
    assert settled(spark, other, ((1, "A@B", 1, 5, 3), (2, "C@D", 1, 1, 0), (3, "E@F", 1, 1, 0))) == ["win", "lose"]


def test_label_counts_shuffle_no_label_text(spark):
    from asofkit.plans.settlement import settlement_by_label

    plan = settlement_by_label(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, x in enumerate(plan) if "Join LeftOuter" in x]
    assert joins and not any("regexp_replace" in x for x in plan[: joins[0]])
