"""Readers, repairs and table contracts."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from asofkit.operators import quality as Q
from asofkit.sources import files as S
from asofkit.sources import flatten as J
from asofkit.sources import repair as R


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿id,v,w\n1,2.5,a\n2,,b\n".encode())
    sch = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("w", T.StringType())])
    df = S.read_csv(spark, str(p), sch, ["id", "v"])
    assert df.columns == ["id", "v"] and [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5), (2, None)]


def test_season_store_prunes_partitions_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(s, i, "x") for s in (1, 2, 3) for i in range(5)], "season int, v int, w string")
    S.write_store(df, str(tmp_path / "s"), ["season"])
    r = S.read_seasons(spark, str(tmp_path / "s"), ["season", "v"], [2])
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "(season#" in plan.split("PartitionFilters")[1] and "ReadSchema: struct<v:int>" in plan and r.count() == 5
    S.replace_partitions(spark.createDataFrame([(2, 99, "n")], "season int, v int, w string"), str(tmp_path / "s"), ["season"])
    assert sorted(x.v for x in S.read_seasons(spark, str(tmp_path / "s"), ["season", "v"]).filter("season = 2").collect()) == [99]
    assert S.read_seasons(spark, str(tmp_path / "s"), ["season", "v"]).count() == 11


def test_schema_checks(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    with pytest.raises(ValueError, match="missing columns"):
        S.map_schema(df, {"z": ("zz", "int")}, "t")
    assert S.map_schema(df, {"n": ("b", "int"), "z": ("zz", "int")}, "t", lax=True).collect()[0].asDict() == {"n": None, "z": None}


def test_odds_pairs_and_sides(spark):
    body = '{"bookmakers":[{"key":"b","markets":[{"key":"hits","outcomes":[{"name":"Over","description":"P","point":0.5,"price":-110},{"name":"Under","description":"P","point":0.5,"price":-105},{"name":"Yes","description":"Q","price":300},{"name":"Over","point":1.5,"price":1}]},{"key":"totals","outcomes":[{"name":"Over","point":8.5,"price":-110},{"name":"Under","point":8.5,"price":-110},{"name":"Over","point":9.5,"price":100}]},{"key":"h2h","outcomes":[{"name":"H","price":-120},{"name":"A","price":110}]}]}]}'
    docs = spark.createDataFrame([(1, "H", "A", body)], "game int, home string, away string, body string")
    p = sorted((r.PlayerName, r.Line, r.OverPrice, r.UnderPrice) for r in J.prop_prices(docs, {"hits": "batter_hits"}).collect())
    assert p == [("P", 0.5, -110, -105), ("Q", 0.5, 300, None)]
    g = sorted((r.Market, r.line, r.over, r.under) for r in J.game_prices(docs).collect())
    assert g == [("h2h", None, -120, 110), ("totals", 8.5, -110, -110)]


def test_repairs(spark):
    st = spark.createDataFrame([(1, dt.date(2024, 1, 1), "a"), (2, dt.date(2024, 1, 9), "b"), (3, dt.date(2024, 1, 10), "c")], "k int, d date, v string")
    fresh = spark.createDataFrame([(2, dt.date(2024, 1, 9), "B"), (4, dt.date(2024, 1, 8), "late"), (9, dt.date(2023, 1, 1), "old")], "k int, d date, v string")
    assert {r.k: r.v for r in R.refetch_merge(st, fresh, ["k"], "d", 2).collect()} == {1: "a", 2: "B", 4: "late"}
    log = spark.createDataFrame([("x", 1, 0), ("x", 2, 5), ("x", 3, 0), ("y", 1, 0), ("y", 2, 0), ("y", 3, 0)], "k string, t int, n int")
    assert {r.k: (r.misses, r.give_up) for r in R.empty_attempts(log, "k", ["t"], "n").collect()} == {"x": (1, False), "y": (3, True)}
    holes = spark.createDataFrame([(1, None, 1), (1, 5.0, 0), (2, None, 1)], "k int, v double, t int")
    assert {r.k: r.v for r in R.prefer_filled(holes, ["k"], "v", ["t"]).collect()} == {1: 5.0, 2: None}
    stubs = spark.createDataFrame([(1, 2, True), (2, 2, True), (3, 9, False)], "k int, n long, stub boolean")
    memo = spark.createDataFrame([(1, 2), (2, 1)], "k int, n long")
    assert [r.k for r in R.open_repairs(stubs, memo, "k").collect()] == [2]


def good(spark, n=50):
    return spark.createDataFrame([(i, 2020 + i % 3, "2024-05-%02d" % (1 + i % 9), "1.5") for i in range(n)], "k int, season int, day string, x string")


C = Q.Contract(columns=("k", "day", "x"), key=("k",), numeric={"x": 0.1}, date="day", max_age_days=6, armed_months=(4, 10), min_rows=10, season="season", shrink_ratio=0.98, shrink_rows=1)


def names(df):
    return sorted(r.check for r in df.collect())


def test_contract_breaks(spark):
    g = good(spark)
    assert names(Q.validate(g, C, g, "2024-05-10")) == []
    assert names(Q.validate(g.drop("x"), C)) == ["columns"]
    assert names(Q.validate(g.unionByName(g.limit(5)), C)) == ["key"]
    assert names(Q.validate(g.selectExpr("k", "season", "day", "if(k < 20, 'bad', x) x"), C)) == ["numeric:x"]
    assert names(Q.validate(g.limit(5), C)) == ["rows"]
    assert names(Q.validate(g, C, today="2024-05-30")) == ["stale"]
    assert names(Q.validate(g, C, today="2024-12-30")) == []          # not armed
    assert names(Q.validate(g, C, today="2024-05-01")) == ["date_future"]
    assert names(Q.validate(g.filter("season <> 2021"), C, g, "2024-05-10")) == ["season", "shrink"]
    assert names(Q.validate(g.filter("k <> 7"), C, g, "2024-05-10")) == []  # within the absolute grace


def test_publish_serves_the_previous_version(spark):
    g = good(spark)
    served, problems = Q.publish(g.limit(20), g, C, "2024-05-10")
    assert served.count() == 50 and problems.count() >= 1
    served, _ = Q.publish(g, g, C, "2024-05-10")
    assert served is g


def test_contract_registry(spark):
    t = spark.createDataFrame([("t", ["a"], ["a"], 3)], "name string, columns array<string>, key array<string>, min_rows int")
    assert Q.contracts_from_table(t)["t"].min_rows == 3
    assert Q.CONTRACTS["minor_game_batting"].key == Q.CONTRACTS["game_batting"].key


def test_boxscore_records_come_from_one_parse(spark):
    import json

    from asofkit.plans.ingest import boxscore_rows
    from asofkit.registry import load_all

    who = lambda i, order, bat, pit: {"person": {"id": i, "fullName": f"P{i}"}, "battingOrder": order, "position": {"abbreviation": "SS"}, "stats": {"batting": bat, "pitching": pit}}
    on = {"gamesPlayed": "1"}
    sides = {"away": {"players": {"ID1": who(1, "100", on | {"hits": "2"}, on | {"outs": "9"}), "ID2": who(2, None, {}, {})}}, "home": {"players": {"ID3": who(3, None, {"gamesPlayed": "0"}, on), "ID4": who(4, "200", {}, {})}}}
    notes = [{"label": "Wind", "value": "12 mph, Out To CF."}, {"label": "Weather", "value": "70 degrees, Clear."}]
    bodies = [json.dumps({"info": notes, "teams": sides}), json.dumps({"info": notes}), "not json", None]
    day = dt.date(2024, 5, 1)
    docs = spark.createDataFrame([(i, 2024, day, "A", "H", b) for i, b in enumerate(bodies)], "GamePk long, Season int, Date date, away string, home string, body string")
    rec = J.boxscore_records(docs, ["hits"], ["outs"])
    got = sorted([(r.GamePk, r.kind, r.PlayerId, r.Team, r.Opponent, r.Home, r.bat_hits, r.pit_outs) for r in rec.filter("kind <> 'game'").collect()], key=lambda r: r[:3])
    assert got == [(0, "bat", 1, "A", "H", 0, "2", None), (0, "bat", 4, "H", "A", 1, "0", None), (0, "pit", 1, "A", "H", 0, None, "9"), (0, "pit", 3, "H", "A", 1, None, "0")]
    game, bat, pit = J.boxscore(docs, ["hits"], ["outs"])
    assert sorted((r.GamePk, r.Temp, r.Condition, r.WindSpeed, r.WindDir) for r in game.collect() if r.GamePk < 2) == [(i, 70, "Clear", 12, "Out To CF") for i in (0, 1)]
    assert {(r.GamePk, r.Temp, r.AwayTeam) for r in game.collect() if r.GamePk > 1} == {(2, None, "A"), (3, None, "A")}
    assert sorted((r.PlayerId, r.BattingOrder, r.hits) for r in bat.collect()) == [(1, "100", "2"), (4, "200", "0")] and sorted((r.PlayerId, r.outs) for r in pit.collect()) == [(1, "9"), (3, "0")]
    load_all()
    plan = boxscore_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Relation [") == 1
