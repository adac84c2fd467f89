"""Settlement of a forecast sheet: label text to a stat expression, one game line per row, day sums only where they are safe.

Rows are placed twice: by what names their game, to meet its final, and by day and entity, to meet that entity's
lines of the day. What a row keeps between the two is narrow: its label is a number, its final is reduced to what its label asks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.labels import LABEL_STAT

# Pitcher labels and the stat behind each (none is the start of another).
PITCHER_STAT = {"strikeouts": "so", "outs": "outs", "hits allowed": "h", "walks": "bb", "earned runs": "er"}
BATTER_STATS = ("h", "b2", "b3", "hr", "tb", "r", "rbi", "bb", "sb")
PITCHER_STATS = tuple(PITCHER_STAT.values())
# What a label asks for, as a number: a side, the total, a team's total, then the batter labels and the pitcher labels in their order.
SIDE, TOTAL, TEAM, BATTER = range(4)
PITCHER = BATTER + len(LABEL_STAT)
# How a row names its game: by id, by its ordinal that day (from 1), or not at all.
BY_ID, ALONE = 0, -1


def scope_of(prop: Column) -> Column:
    """What a label is graded on: side, total, team, pitcher or batter."""
    return (F.when(prop == "moneyline", "side").when(prop == "total runs", "total").when(prop == "team total runs", "team")
            .when(prop.startswith("pitcher "), "pitcher").otherwise("batter"))


def asked(prop: Column) -> Column:
    """What a label asks for, as a number (see ``SIDE`` and on); null for a label of neither batter nor pitcher."""
    scope, rest = scope_of(prop), F.substring(prop, len("pitcher ") + 1, 1000)
    bat = pit = F.lit(None).cast("int")
    for i, (word, _) in reversed(list(enumerate(LABEL_STAT))):  # the first keyword found counts
        bat = F.when(F.contains(prop, F.lit(word)), BATTER + i).otherwise(bat)
    for i, label in enumerate(PITCHER_STAT):
        pit = F.when(rest.startswith(label), PITCHER + i).otherwise(pit)
    return F.when(scope == "side", SIDE).when(scope == "total", TOTAL).when(scope == "team", TEAM).when(scope == "pitcher", pit).otherwise(bat)


def named_finals(sheet: DataFrame, finals: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` (of ``finals``, with ``final_game``) once per way in which a row of ``sheet`` may name one, with ``day_ok`` (the matchup had one game that day, and it is final).

    A game id pins the final; else the ordinal counts, but only when the finals cover every game that
    the matchup is known to have had that day; a row with neither needs a day of one game.
    """
    key = ["d", "matchup"]
    w = Window.partitionBy(*key).orderBy("start", "final_game")  # the games of one matchup and day: a few
    known = sheet.filter("gnum IS NOT NULL").groupBy(*key).agg(F.max("gnum").alias("n_known"))
    counts = finals.groupBy(*key).agg(F.count(F.lit(1)).alias("n_final")).join(known, key, "left")
    counts = counts.select(*key, "n_final", F.greatest("n_final", F.coalesce("n_known", F.lit(0))).alias("n_day"))
    rows = facts.withColumn("k", F.row_number().over(w)).join(counts, key).withColumn("day_ok", (F.col("n_final") == 1) & (F.col("n_day") == 1))
    name = lambda k, has_id=False: F.struct(k.cast("int").alias("final_game_k"), F.when(F.lit(has_id), F.col("final_game")).alias("final_game_id"))
    names = F.array(name(F.lit(BY_ID), True), F.when(F.col("n_final") == F.col("n_day"), name(F.col("k"))), F.when(F.col("day_ok"), name(F.lit(ALONE))))
    return rows.select(*facts.columns, "day_ok", F.inline(F.array_compact(names))).drop("start")


def day_lines(batters: DataFrame, pitchers: DataFrame) -> DataFrame:
    """Per kind of label (1: pitchers), day and entity: ``__by_game``, the stats of each game, and ``__of_day``, their sums. One shuffle of the lines."""
    stats = tuple(dict.fromkeys(BATTER_STATS + PITCHER_STATS))
    of = lambda box, kind, names: box.select(F.lit(kind).alias("__kind"), "d", "entity", "game", *names)
    lines = of(batters, 0, BATTER_STATS).unionByName(of(pitchers, 1, PITCHER_STATS), allowMissingColumns=True)
    key = ["__kind", "d", "entity"]
    lines = lines.repartition(*key).groupBy(*key, "game").agg(*[F.sum(s).alias(s) for s in stats])
    return lines.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("game").isNotNull(), F.struct("game", F.struct(*stats))))).alias("__by_game"), F.struct(*[F.sum(s).alias(s) for s in stats]).alias("__of_day"))


def settle_sheet(sheet: DataFrame, batters: DataFrame, pitchers: DataFrame, finals: DataFrame) -> DataFrame:
    """``sheet`` (d, matchup, gamepk, gnum, prop, side, line, team, entity) with ``actual`` and ``result``: win, lose, push, void or open.

    ``batters``: game, d, entity and BATTER_STATS; ``pitchers``: game, d, entity, started and PITCHER_STATS;
    ``finals``: game, d, matchup, start, home, away, home_score, away_score; the lines of a game have its day. A player's line is that of the row's own
    game; only on a day of one game may the day's sum stand in. Starts alone grade pitchers. A player
    without a line in a final game whose box is there did not play: void. All else without an answer stays open.
    Boxes are read twice: give tables, not long plans.
    """
    facts = finals.withColumnRenamed("game", "final_game")
    for box, name in ((batters, "bat_boxed"), (pitchers, "pit_boxed")):
        facts = facts.join(box.select(F.col("game").alias("final_game")).distinct().withColumn(name, F.lit(True)), "final_game", "left")
    k = F.when(F.col("gamepk").isNotNull(), BY_ID).when(F.col("gnum") > 0, F.col("gnum")).when(F.col("gnum").isNull(), ALONE)
    rows = sheet.filter("d IS NOT NULL AND matchup IS NOT NULL").withColumns({"__ask": asked(F.col("prop")), "final_game_k": k, "final_game_id": F.col("gamepk")})
    rows = rows.withColumn("__ask_team", F.when(F.col("__ask") == TEAM, F.col("team")))
    facts = named_finals(sheet, finals, facts)
    name = ["d", "matchup", "final_game_k"]  # rows without a final are spread by their own day and matchup
    match = [rows[c] == facts[c] for c in name] + [rows["final_game_id"].eqNullSafe(facts["final_game_id"])]
    rows = rows.join(facts, match, "left").drop(*[facts[c] for c in (*name, "final_game_id")])
    # of the final, only what the label asks for
    ask, known = F.col("__ask"), F.col("final_game").isNotNull()
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home")).otherwise(F.col("away"))
    score = F.when(F.col("__ask_team") == F.col("home"), F.col("home_score")).otherwise(F.col("away_score"))
    player = known & (ask >= BATTER)
    rows = rows.select(
        *sheet.columns, "__ask", F.when(~known, "open").when(ask == SIDE, F.when(winner == F.col("side"), "win").otherwise("lose")).alias("__settled"),
        F.when(ask == TOTAL, F.col("home_score") + F.col("away_score")).when(ask == TEAM, score).cast("double").alias("__of_game"),
        F.when(player, (ask >= PITCHER).cast("int")).alias("__kind"), F.when(player, F.col("final_game")).alias("__game"), F.when(player, F.col("day_ok")).alias("__day_ok"),
        F.when(player, F.coalesce(F.when(ask >= PITCHER, F.col("pit_boxed")).otherwise(F.col("bat_boxed")), F.lit(False))).alias("__boxed"))
    rows = rows.join(day_lines(batters, pitchers.filter("started = 1")), ["__kind", "d", "entity"], "left")
    rows = rows.withColumn("__stat", F.coalesce(F.element_at("__by_game", F.col("__game")), F.when(F.col("__day_ok"), F.col("__of_day"))))
    value = F.col("__of_game")
    for i, expr in [*enumerate([e for _, e in LABEL_STAT], BATTER), *enumerate(PITCHER_STATS, PITCHER)]:
        value = F.when(ask == i, F.expr(re.sub(r"[a-z]\w*", r"__stat.\g<0>", expr)).cast("double")).otherwise(value)
    rows = rows.select(*sheet.columns, "__settled", "__boxed", value.alias("actual"))
    over, a, ln = F.col("side") == "Over", F.col("actual"), F.col("line")
    graded = F.when(a == ln, "push").when((a > ln) == over, "win").when((a > ln) != over, "lose")
    unplayed = F.col("__boxed") & ln.isNotNull() & a.isNull() & F.col("entity").isNotNull()
    return rows.select(*sheet.columns, "actual", F.coalesce("__settled", F.when(unplayed, "void").otherwise(graded), F.lit("open")).alias("result"))
