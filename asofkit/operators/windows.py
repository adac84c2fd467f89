"""Window-shaped operators at day or game grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.asof import day_number
from asofkit.operators.scan import Index, Running, ordered_scan


def trailing_sums(
    rows: DataFrame, daily: DataFrame, entity: Sequence[str], date: str, cols: Sequence[str], windows: dict[str, int]
) -> DataFrame:
    """Sums over the last n days before each row's day (that day excluded), one column per window.

    Day-grain questions and day sums share one range-framed window per entity.
    """
    entity = list(entity)
    asks = rows.select(*entity, date).distinct().withColumn("__ask", F.lit(1))
    src = daily.select(*entity, date, *cols)
    both = asks.unionByName(src, allowMissingColumns=True).withColumn("__n", day_number(F.col(date)))
    w = Window.partitionBy(*entity).orderBy("__n")
    out = [F.coalesce(F.sum(c).over(w.rangeBetween(-n, -1)), F.lit(0)).alias(f"{c}_{name}") for name, n in windows.items() for c in cols]
    res = both.select(*entity, date, "__ask", *out).filter("__ask = 1").drop("__ask")
    return rows.join(res, [*entity, date], "left")


def rest_days(daily: DataFrame, entity: Sequence[str], date: str, cap: int = 30) -> DataFrame:
    w = Window.partitionBy(*entity).orderBy(date)
    return daily.withColumn("rest", F.least(F.datediff(date, F.lag(date).over(w)), F.lit(cap)))


def last_n_form(
    team_games: DataFrame, team: str, season: str, date: str, order: Sequence[str], cols: Sequence[str], n: int
) -> DataFrame:
    """Means over the last n games finished on earlier dates of the season; games of the same day stay unseen.

    Prefix sums per team-season by game order; the value is the difference of the prefix
    at the last earlier-day game and the prefix n games before it.
    """
    key = [team, season]
    pre = ordered_scan(team_games.select(*key, date, *order, *cols), key, [F.col(c) for c in (date, *order)], F.col(date),
                       [Index("__i"), *[Running(f"__s_{c}", F.col(c)) for c in cols]])
    day = pre.groupBy(*key, date).agg(F.max("__i").alias("__hi"))
    wd = Window.partitionBy(*key).orderBy(date)
    day = day.withColumn("__nb", F.coalesce(F.lag("__hi").over(wd), F.lit(0))).withColumn(
        "__na", F.greatest(F.col("__nb") - n, F.lit(0)))
    hi = pre.select(*key, F.col("__i").alias("__nb"), *[F.col(f"__s_{c}").alias(f"__h_{c}") for c in cols])
    lo = pre.select(*key, F.col("__i").alias("__na"), *[F.col(f"__s_{c}").alias(f"__l_{c}") for c in cols])
    j = day.join(hi, [*key, "__nb"], "left").join(lo, [*key, "__na"], "left")
    used = F.col("__nb") - F.col("__na")
    out = j.select(*key, date, F.col("__nb").alias("n_before"), *[
        (F.when(used > 0, (F.col(f"__h_{c}") - F.coalesce(F.col(f"__l_{c}"), F.lit(0))) / used)).alias(f"{c}_last{n}") for c in cols])
    return team_games.join(out, [*key, date], "left")


def season_totals_before(team_games: DataFrame, team: str, season: str, date: str, cols: Sequence[str]) -> DataFrame:
    """Season sums over earlier dates, one row per (team, season, date)."""
    day = team_games.groupBy(team, season, date).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in cols])
    w = Window.partitionBy(team, season).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return day.select(team, season, date, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("games"),
                      *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_sofar") for c in cols])


def pythagorean(rf: Column, ra: Column, n: Column, exponent: float = 1.83, min_games: int = 20) -> Column:
    a, b = F.pow(rf.cast("double"), exponent), F.pow(ra.cast("double"), exponent)
    return F.when(n >= min_games, a / F.greatest(a + b, F.lit(1e-9)))


def ladder_clamp(df: DataFrame, ladder: Sequence[str], line: str, p: str, out: str) -> DataFrame:
    """Make probabilities non-increasing in the line. A ladder holds a few rungs; equal lines
    are folded first so the window is bounded by the number of distinct rungs."""
    rungs = df.groupBy(*ladder, line).agg(F.min(p).alias("__p"))
    w = Window.partitionBy(*ladder).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(rungs.select(*ladder, line, F.min("__p").over(w).alias(out)), [*ladder, line])


def clear_leader(df: DataFrame, group: Sequence[str], p: str, tie: Sequence[Column], margin: float = 0.25) -> DataFrame:
    """Top row per group with a flag: its log odds lead the runner-up by at least ``margin``."""
    from asofkit.functions.prob import logit
    from asofkit.operators.scan import top_k

    two = top_k(df, group, [F.desc(p), *tie], 2, "__r")
    top = two.filter("__r = 1").drop("__r")
    second = two.filter("__r = 2").select(*group, F.col(p).alias("__p2"))
    j = top.join(second, list(group), "left").withColumn("margin", logit(p) - logit("__p2"))
    return j.withColumn("clear", F.coalesce(F.col("margin") >= margin, F.lit(False))).drop("__p2")


def date_runs(dates: DataFrame, keys: Sequence[str], date: str, gap: int) -> DataFrame:
    """Runs of days whose gaps are at most ``gap``; input one row per (keys, date)."""
    w = Window.partitionBy(*keys).orderBy(date)
    new = F.coalesce((F.datediff(date, F.lag(date).over(w)) > gap).cast("int"), F.lit(1))
    runs = dates.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n_days"))


def stints(events: DataFrame, entity: str, date: str, seq: Column, kind: str, days: str) -> DataFrame:
    """Pair placements with activations into [place, act) stints; the last may stay open.

    A group is what lies between two activations. Day-chunked running counts keep a hot
    entity out of a single task.
    """
    order = [F.col(date), seq]
    closes = F.when(F.col(kind) == "activate", 1).otherwise(0)
    g = ordered_scan(events, [entity], order, F.col(date), [Running("__grp", closes, inclusive=False)])
    pos = F.struct(F.col(date).alias("d"), seq.alias("s"))
    opens = F.col(kind).isin("place", "transfer")
    first = g.groupBy(entity, "__grp").agg(
        F.min(F.when(opens, pos)).alias("__open"),
        F.max(F.when(F.col(kind) == "activate", F.col(date))).alias("act_date"),
        F.max(F.when(opens, (F.coalesce(F.col(days), F.lit(0)) >= 60).cast("int"))).alias("il60"),
        F.max(F.when(F.col(kind) == "rehab", pos)).alias("__rehab"))
    return first.filter(F.col("__open").isNotNull()).select(
        entity, F.col("__open.d").alias("place_date"), "act_date", F.datediff("act_date", F.col("__open.d")).alias("stint_days"), "il60",
        F.coalesce((F.col("__rehab") > F.col("__open")).cast("int"), F.lit(0)).alias("rehab"))


def first_off_day(schedule: DataFrame, team: str, date: str, after: str, days: int) -> DataFrame:
    """First date in (after, after+days] without a game, per team."""
    cal = schedule.select(team).distinct().select(
        team, F.explode(F.sequence(F.date_add(F.lit(after).cast("date"), 1), F.date_add(F.lit(after).cast("date"), days))).alias(date))
    return cal.join(schedule.select(team, date).distinct(), [team, date], "left_anti").groupBy(team).agg(F.min(date).alias("off_day"))
