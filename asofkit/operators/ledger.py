"""Graded ledger over three grains of box lines: every market of every line at once, with a probability as of its day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.labels import BATTER_EVENTS

# Family of each batter market, and of each pitcher line with its stat and label.
BATTER_FAMILY = {
    "HR": "hr", "Hit": "h", "2+ Hits": "h", "Single": "b1", "Double": "b2", "Triple": "b3", "2+ TB": "tb", "3+ TB": "tb", "4+ TB": "tb", "Run": "r", "2+ Runs": "r",
    "RBI": "rbi", "2+ RBI": "rbi", "H+R+RBI 2+": "hrr", "H+R+RBI 3+": "hrr", "H+R+RBI 4+": "hrr", "BB": "bb", "SB": "sb", "K": "bk", "2+ K": "bk", "3+ K": "bk",
}
PITCHER_FAMILY = {"pk": ("K", "so"), "pout": ("Outs", "outs"), "pha": ("Hits", "h"), "pbb": ("BB", "bb"), "per": ("ER", "er")}


def _rows(family: str, market: str, y: str, entity: str):
    return F.struct(F.lit(family).alias("family"), F.lit(market).alias("market"), F.expr(y).cast("int").alias("y"), F.expr(entity).cast("string").alias("who"))


def _grains(batters: DataFrame, pitchers: DataFrame, finals: DataFrame, lines: dict[str, Sequence[float]]) -> list[tuple[DataFrame, str, list[tuple[str, str, str]]]]:
    """(lines of one grain, who they are about, (family, market, outcome) of each of its markets), void lines left out."""
    bat = [(BATTER_FAMILY[m], m, e) for m, e in BATTER_EVENTS.items()]
    pit = [(fam, f"{label} > {x}", f"{stat} > {x}") for fam, (label, stat) in PITCHER_FAMILY.items() for x in lines[fam]]
    home = [("ml", "home ML", "home_score > away_score"), *[("tot", f"Runs > {x}", f"home_score + away_score > {x}") for x in lines["tot"]]]
    away, home = ([*start, *[("tt", f"{side} Runs > {x}", f"{side.lower()}_score > {x}") for x in lines["tt"]]] for side, start in (("Away", []), ("Home", home)))
    scored = finals.filter("home_score IS NOT NULL AND away_score IS NOT NULL")
    parts = ((batters.filter("pa > 0"), "entity", bat), (pitchers.filter("started = 1"), "entity", pit), (scored, "home", home), (scored, "away", away))
    return [g for g in parts if g[2]]


def graded(batters: DataFrame, pitchers: DataFrame, finals: DataFrame, lines: dict[str, Sequence[float]]) -> DataFrame:
    """(game, d, family, market, who, y): the 21 batter events, five pitcher lines and three game families that a box answers.

    A batter without an appearance, a pitcher who did not start and a game without both scores are void: they
    give no row rather than a lost one. ``lines`` names the lines of ``pk pout pha pbb per tot tt``.
    """
    out = None
    for df, who, markets in _grains(batters, pitchers, finals, lines):
        one = df.select("game", "d", F.explode(F.array(*[_rows(*m, who) for m in markets])).alias("r")).select("game", "d", "r.family", "r.market", "r.who", "r.y")
        out = one if out is None else out.unionByName(one)
    return out


def graded_totals(batters: DataFrame, pitchers: DataFrame, finals: DataFrame, lines: dict[str, Sequence[float]], k: float = 20.0) -> DataFrame:
    """(family, market, who, n, known, hits, expected, loss): ``priced(graded(...))`` summed per market and who.

    A price depends on (market, who, day) alone, so the markets of a line stay side by side as columns: days, running
    sums and totals of a who are made once for all of them, and its markets become rows only at the end.
    ``known`` counts the rows with an outcome; ``loss`` is the sum of their log losses.
    """
    out = None
    for df, who, markets in _grains(batters, pitchers, finals, lines):
        at = range(len(markets))
        y = df.select(F.col(who).cast("string").alias("who"), "d", *[F.expr(e).cast("int").alias(f"y{i}") for i, (_, _, e) in enumerate(markets)])
        day = y.groupBy("who", "d").agg(F.count(F.lit(1)).alias("n"), *[F.count(f"y{i}").alias(f"c{i}") for i in at], *[F.sum(f"y{i}").alias(f"s{i}") for i in at])
        sums = ["n", *[f"s{i}" for i in at]]
        before = lambda *keys: Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
        own = day.filter("who IS NOT NULL AND d IS NOT NULL").select("*", *[so_far(c, before("who")).alias(f"{c}_own") for c in sums])
        # One row per day of the calendar, over everybody; that table alone goes through one task.
        league = y.groupBy("d").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"s{i}") for i in at]).filter("d IS NOT NULL").withColumn("__all", F.lit(1))
        league = league.select("d", *[so_far(c, before("__all")).alias(f"{c}_all") for c in sums])
        both = own.join(league, "d")
        base = lambda i: (F.col(f"s{i}_all") + 1.0) / (F.col("n_all") + 2.0)
        both = both.select("*", *[((F.col(f"s{i}_own") + k * base(i)) / (F.col("n_own") + k)).alias(f"p{i}") for i in at])
        loss = lambda i: -(F.col(f"s{i}") * F.log(f"p{i}") + (F.col(f"c{i}") - F.col(f"s{i}")) * F.log(1 - F.col(f"p{i}")))
        per = both.groupBy("who").agg(F.sum("n").alias("n"), *[x for i in at for x in (F.sum(f"c{i}").alias(f"c{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.sum(F.col("n") * F.col(f"p{i}")).alias(f"e{i}"), F.sum(loss(i)).alias(f"l{i}"))])
        cells = [F.struct(F.lit(f).alias("family"), F.lit(m).alias("market"), F.col(f"c{i}").alias("known"), F.col(f"s{i}").alias("hits"), F.col(f"e{i}").alias("expected"), F.col(f"l{i}").alias("loss")) for i, (f, m, _) in enumerate(markets)]
        one = per.select("who", "n", F.explode(F.array(*cells)).alias("r")).select("r.family", "r.market", "who", "n", "r.known", "r.hits", "r.expected", "r.loss")
        out = one if out is None else out.unionByName(one)
    return out


def priced(rows: DataFrame, k: float = 20.0) -> DataFrame:
    """``rows`` with ``p``: share of cleared rows of the same (who, market) on earlier days, shrunk to the market's share on earlier days.

    Both histories are running sums over days, joined back by day; a market without an earlier day stands at one half.
    """
    day = rows.groupBy("market", "who", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    own = day.select("market", "who", "d", *[F.coalesce(F.sum(c).over(before("market", "who")), F.lit(0)).alias(f"{c}_own") for c in "ns"])
    league = day.groupBy("market", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    league = league.select("market", "d", *[F.coalesce(F.sum(c).over(before("market")), F.lit(0)).alias(f"{c}_all") for c in "ns"])
    base = (F.col("s_all") + 1.0) / (F.col("n_all") + 2.0)
    both = rows.join(own, ["market", "who", "d"]).join(league, ["market", "d"])
    return both.withColumn("p", (F.col("s_own") + k * base) / (F.col("n_own") + k)).drop("n_own", "s_own", "n_all", "s_all")
