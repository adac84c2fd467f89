"""Window operators on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.functions.physics import haversine_km, zone_shift_hours
from asofkit.operators import windows as W
from asofkit.operators.scan import Index, Previous, Running, group_totals, ordered_scan, top_k
from asofkit.plans._roles import EV, GAMES, LED, PA, PA_ORD, PA_ORDER, appearances, events, games, ledger, table
from asofkit.registry import query
from asofkit.session import cut_lineage

ORD = PA_ORDER


@query("W2 W9 W24 L1", f"""
WITH {PA} SELECT game, seq, batter, pitcher, row_number() OVER w AS bf, CAST(sum(CASE WHEN label = 'cR' THEN 1 ELSE 0 END) OVER w - CASE WHEN label = 'cR' THEN 1 ELSE 0 END AS BIGINT) AS k_so_far,
 round(sum(qty) OVER w - qty, 4) AS effort_before, qty - first(qty) OVER w AS qty_since_first
FROM pa WINDOW w AS (PARTITION BY game ORDER BY {PA_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_counts(spark, d):
    """Exclusive running counts inside a game; the position-chunked scan keeps any one game splittable."""
    k = F.when(F.col("label") == "cR", 1).otherwise(0)
    r = ordered_scan(appearances(spark, d), ["game"], ORD, F.col("seq"), [
        Index("bf"), Running("k_so_far", k, inclusive=False), Running("effort_before", F.col("qty"), inclusive=False)])
    first = r.groupBy("game").agg(F.min_by("qty", F.struct(*ORD)).alias("q0"))
    return r.join(first, "game").select("game", "seq", "batter", "pitcher", "bf", "k_so_far", F.round("effort_before", 4).alias("effort_before"),
                                        (F.col("qty") - F.col("q0")).alias("qty_since_first"))


@query("W4", f"""
WITH {PA}, st AS (SELECT pitcher, d, count(*) AS np, sum(qty) AS outs FROM pa GROUP BY 1, 2)
SELECT pitcher, d, CAST(date_diff('day', lag(d) OVER w, d) AS INT) AS gap_days, CAST(coalesce(lag(np) OVER w < 2, FALSE) AS INT) AS ramp, CAST(coalesce(lag(outs) OVER w <= 12, FALSE) AS INT) AS prev_short
FROM st WINDOW w AS (PARTITION BY pitcher ORDER BY d)""")
def previous_start(spark, d):
    st = appearances(spark, d).groupBy("pitcher", "d").agg(F.count(F.lit(1)).alias("np"), F.sum("qty").alias("outs"))
    w = Window.partitionBy("pitcher").orderBy("d")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return st.select("pitcher", "d", F.datediff("d", F.lag("d").over(w)).alias("gap_days"),
                     flag(F.lag("np").over(w) < 2).alias("ramp"), flag(F.lag("outs").over(w) <= 12).alias("prev_short"))


@query("W6 J6", f"""
WITH {EV}, dd AS (SELECT user_id, d, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, d, CAST(least(date_diff('day', lag(d) OVER w, d), 30) AS INT) AS rest,
 CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS n_7,
 CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS n_14
FROM dd WINDOW w AS (PARTITION BY user_id ORDER BY d)""")
def rest_and_load(spark, d):
    daily = events(spark, d).groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n"))
    r = W.rest_days(W.trailing_sums(daily, daily, ["user_id"], "d", ["n"], {"7": 7, "14": 14}), ["user_id"], "d")
    return r.select("user_id", "d", "rest", "n_7", "n_14")


@query("W7 W22", f"""
WITH {PA}, dd AS (SELECT d, count(*) AS n, sum(CAST(round(price * 100) AS BIGINT)) AS v FROM pa GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM dd), (SELECT max(d) + 40 FROM dd), INTERVAL 1 DAY)) AS DATE) AS d),
c AS (SELECT cal.d, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM cal LEFT JOIN dd ON cal.d = dd.d),
w AS (SELECT d, sum(n) OVER (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS n30, sum(v) OVER (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS v30 FROM c)
SELECT d, CAST(coalesce(n30, 0) AS BIGINT) AS n30, round(CASE WHEN n30 >= 500 THEN v30 / n30 END, 4) AS env_cents FROM w""")
def trailing_environment(spark, d):
    """League level over the 30 days before each calendar day, NULL on a thin sample; one row per day."""
    daily = appearances(spark, d).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("v")).withColumn("lg", F.lit(1))
    b = daily.agg(F.min("d").alias("a"), F.date_add(F.max("d"), 40).alias("b"))
    cal = b.select(F.explode(F.sequence("a", "b")).alias("d")).withColumn("lg", F.lit(1))
    r = W.trailing_sums(cal, daily, ["lg"], "d", ["n", "v"], {"30": 30})
    return r.select("d", F.col("n_30").alias("n30"), F.round(F.when(F.col("n_30") >= 500, F.col("v_30") / F.col("n_30")), 4).alias("env_cents"))


@query("W8", f"""
WITH {PA}, l AS (SELECT game, label, lag(label) OVER (PARTITION BY game ORDER BY {PA_ORD}) AS prev FROM pa)
SELECT game, count(prev) AS pairs, CAST(count(*) FILTER (WHERE label = prev) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE prev = 'cN' AND label = 'cR') AS BIGINT) AS n_to_r FROM l GROUP BY 1""")
def adjacent_transitions(spark, d):
    l = ordered_scan(appearances(spark, d), ["game"], ORD, F.col("seq"), [Previous("prev", F.col("label"))])  # noqa: E741
    return l.groupBy("game").agg(F.count("prev").alias("pairs"), F.count_if(F.col("label") == F.col("prev")).alias("same"),
                                 F.count_if((F.col("prev") == "cN") & (F.col("label") == "cR")).alias("n_to_r"))


@query("W10", f"""
WITH {PA}, dd AS (SELECT pitcher, season, d, sum(qty) AS q FROM pa GROUP BY 1, 2, 3)
SELECT pitcher, season, d, round(sum(q) OVER (PARTITION BY pitcher, season ORDER BY d), 4) AS q_season FROM dd""")
def season_running_total(spark, d):
    dd = appearances(spark, d).groupBy("pitcher", "season", "d").agg(F.sum("qty").alias("q"))
    w = Window.partitionBy("pitcher", "season").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return dd.select("pitcher", "season", "d", F.round(F.sum("q").over(w), 4).alias("q_season"))


TEAM_SQL = """tg AS (SELECT game, d, season, home AS team, home_score AS rf, away_score AS ra FROM games WHERE home_score IS NOT NULL
 UNION ALL SELECT game, d, season, away, away_score, home_score FROM games WHERE home_score IS NOT NULL)"""


def _team_games(spark, d, scored=True):
    g = games(spark, d)
    if scored:
        g = g.filter("home_score IS NOT NULL")
    side = F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_score").alias("rf"), F.col("away_score").alias("ra"), F.lit(1).alias("at_home")),
                             F.struct(F.col("away").alias("team"), F.col("away_score").alias("rf"), F.col("home_score").alias("ra"), F.lit(0).alias("at_home"))))
    return g.select("game", "d", "season", "venue", "daynight", side.alias("s")).select("game", "d", "season", "venue", "daynight", "s.*")


@query("W11", f"""
WITH {GAMES}, {TEAM_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY d, game) AS i FROM tg),
b AS (SELECT a.team, a.season, a.game, coalesce(max(p.i), 0) AS nb FROM s a LEFT JOIN s p ON a.team = p.team AND a.season = p.season AND p.d < a.d GROUP BY 1, 2, 3)
SELECT b.team, b.game, b.nb AS n_before, round(avg(CASE WHEN p.rf > p.ra THEN 1.0 WHEN p.rf IS NOT NULL THEN 0 END), 6) AS win_last10, round(avg(p.rf), 6) AS rf_last10, round(avg(p.ra), 6) AS ra_last10
FROM b LEFT JOIN s p ON p.team = b.team AND p.season = b.season AND p.i <= b.nb AND p.i > b.nb - 10 GROUP BY 1, 2, 3""")
def last_ten_form(spark, d):
    """Form over the last ten games of earlier dates; same-day results stay invisible."""
    tg = _team_games(spark, d).withColumn("win", F.when(F.col("rf") > F.col("ra"), 1.0).otherwise(0.0))
    r = W.last_n_form(tg, "team", "season", "d", ["game"], ["win", "rf", "ra"], 10)
    return r.select("team", "game", F.col("n_before").cast("long").alias("n_before"), *[F.round(f"{c}_last10", 6).alias(f"{c}_last10") for c in ("win", "rf", "ra")])


STAFF_SQL = """sg AS (SELECT home AS team, games.season, games.d, games.game, coalesce(CAST(sum(qty) FILTER (WHERE seq = 1) AS DOUBLE), 0) AS st, coalesce(CAST(sum(qty) FILTER (WHERE seq > 1) AS DOUBLE), 0) AS po,
 CAST(count(*) FILTER (WHERE seq > 1 AND label = 'cR') AS DOUBLE) AS er, CAST(count(*) FILTER (WHERE seq > 1) AS DOUBLE) AS np, any_value(home_score) - CAST(count(*) AS DOUBLE) AS luck FROM games JOIN pa ON pa.game = games.game GROUP BY ALL)"""


def _staff_games(spark, d):
    """Per home game: the first arm's outs, the others' outs, runs and pitches, and runs over their estimate."""
    pa = appearances(spark, d).select("game", "seq", "qty", "label")
    late = F.col("seq") > 1
    q = F.col("qty").cast("double")
    per = pa.groupBy("game").agg(
        F.sum(F.when(~late, q).otherwise(0.0)).alias("st"), F.sum(F.when(late, q).otherwise(0.0)).alias("po"), F.count_if(late & (F.col("label") == "cR")).cast("double").alias("er"),
        F.count_if(late).cast("double").alias("np"), F.count(F.lit(1)).cast("double").alias("__est"))
    g = games(spark, d).select(F.col("home").alias("team"), "season", "d", "game", "home_score").join(per, "game")
    return g.withColumn("luck", F.col("home_score") - F.col("__est")).drop("home_score", "__est")


def _last_sql(src: str, name: str, cols: str, n: int, where: str = "TRUE") -> str:
    """CTEs numbering the rows of ``src`` and averaging ``cols`` over the n rows of earlier dates of the season."""
    avgs = ", ".join(f"avg(p.{c}) AS {c}" for c in cols.split())
    return f"""{name}_s AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY d, game) AS i FROM {src} WHERE {where}),
{name}_b AS (SELECT a.team, a.season, a.game, coalesce(max(p.i), 0) AS nb FROM {name}_s a LEFT JOIN {name}_s p ON a.team = p.team AND a.season = p.season AND p.d < a.d GROUP BY 1, 2, 3),
{name} AS (SELECT b.team, b.game, {avgs} FROM {name}_b b LEFT JOIN {name}_s p ON p.team = b.team AND p.season = b.season AND p.i <= b.nb AND p.i > b.nb - {n} GROUP BY 1, 2)"""


@query("W11", f"""
WITH {GAMES}, {PA}, {STAFF_SQL}, lk AS (SELECT * FROM sg WHERE luck IS NOT NULL), {_last_sql('sg', 'pen', 'er po', 30, 'po > 0')}, {_last_sql('sg', 'sta', 'st', 20)}, {_last_sql('lk', 'luk', 'luck', 20)},
load AS (SELECT a.game, coalesce(sum(p.np), 0) AS pen_load FROM sg a LEFT JOIN sg p ON p.team = a.team AND p.season = a.season AND p.d < a.d AND p.d >= a.d - 3 GROUP BY 1)
SELECT sg.team, sg.game, round(27.0 * pen.er / nullif(pen.po, 0), 6) AS pen_era30, round(sta.st, 6) AS starter_outs20, round(luk.luck, 6) AS luck20, pen_load
FROM sg JOIN load USING (game) LEFT JOIN pen ON pen.game = sg.game LEFT JOIN sta ON sta.game = sg.game LEFT JOIN luk ON luk.game = sg.game""")
def staff_form(spark, d):
    """Bullpen run average over its last thirty games, starter outs and estimate luck over twenty, bullpen load of three days; earlier dates of the season only."""
    from asofkit.operators.windows import trailing_sums

    g = cut_lineage(_staff_games(spark, d))
    last = lambda df, cols, n: W.last_n_form(df.select("team", "season", "d", "game", *cols), "team", "season", "d", ["game"], cols, n).select("game", *[f"{c}_last{n}" for c in cols])
    pen, st, luck = last(g.filter("po > 0"), ["er", "po"], 30), last(g, ["st"], 20), last(g.filter("luck IS NOT NULL"), ["luck"], 20)
    day = g.groupBy("team", "season", "d").agg(F.sum("np").alias("np"))
    load = trailing_sums(g.select("team", "season", "d", "game"), day, ["team", "season"], "d", ["np"], {"3": 3}).select("game", F.coalesce("np_3", F.lit(0.0)).alias("pen_load"))
    j = g.select("team", "game").join(load, "game").join(pen, "game", "left").join(st, "game", "left").join(luck, "game", "left")
    return j.select("team", "game", F.round(27.0 * F.col("er_last30") / F.nullif("po_last30", F.lit(0.0)), 6).alias("pen_era30"), F.round("st_last20", 6).alias("starter_outs20"),
                    F.round("luck_last20", 6).alias("luck20"), "pen_load")


@query("W11 X13", f"""
WITH {GAMES}, {TEAM_SQL}, dd AS (SELECT team, season, d, count(*) AS n, sum(rf) AS rf, sum(ra) AS ra FROM tg GROUP BY 1, 2, 3),
r AS (SELECT team, season, d, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(rf) OVER w, 0) AS rf, coalesce(sum(ra) OVER w, 0) AS ra FROM dd
 WINDOW w AS (PARTITION BY team, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT team, season, d, CAST(n AS BIGINT) AS games, round(CASE WHEN n >= 20 THEN power(rf, 1.83) / greatest(power(rf, 1.83) + power(ra, 1.83), 1e-9) END, 6) AS pyth FROM r""")
def pythagorean_before(spark, d):
    t = W.season_totals_before(_team_games(spark, d), "team", "season", "d", ["rf", "ra"])
    return t.select("team", "season", "d", "games", F.round(W.pythagorean(F.col("rf_sofar"), F.col("ra_sofar"), F.col("games")), 6).alias("pyth"))


@query("W13 X12", f"""
WITH {GAMES}, t AS (SELECT game, d, venue, daynight, home AS team FROM games UNION ALL SELECT game, d, venue, daynight, away FROM games),
l AS (SELECT *, lag(d) OVER w AS pd, lag(venue) OVER w AS pv, lag(daynight) OVER w AS pdn FROM t WINDOW w AS (PARTITION BY team ORDER BY d, game, daynight))
SELECT team, game, CAST(date_diff('day', pd, d) AS INT) AS rest, CAST(coalesce(date_diff('day', pd, d) = 1, FALSE) AS INT) AS b2b,
 round(coalesce(2 * 6371.0 * asin(sqrt(power(sin(radians(venue - pv) / 2), 2) + cos(radians(20.0 + pv)) * cos(radians(20.0 + venue)) * power(sin(radians(-3.0 * (venue - pv)) / 2), 2))), 0), 4) AS travel_km,
 round(coalesce((-3.0 * (venue - pv)) / 15.0, 0), 6) AS tz_shift, CAST(coalesce(date_diff('day', pd, d) = 1 AND pdn = 'night' AND daynight = 'day', FALSE) AS INT) AS day_after_night FROM l""")
def schedule_spots(spark, d):
    """Rest, travel and zone shift from the previous game, which may be the same day."""
    t = _team_games(spark, d, scored=False)
    prev = ordered_scan(t, ["team"], [F.col("d"), F.col("game"), F.col("daynight")], F.col("d"),
                        [Previous("p", F.struct("d", "venue", "daynight"))])
    lat, lon = (lambda c: 20.0 + F.col(c)), (lambda c: -3.0 * F.col(c) - 70.0)
    rest = F.datediff("d", "p.d")
    dan = (rest == 1) & (F.col("p.daynight") == "night") & (F.col("daynight") == "day")
    zero = F.lit(0.0)
    return prev.select(
        "team", "game", rest.alias("rest"), F.coalesce(rest == 1, F.lit(False)).cast("int").alias("b2b"),
        F.round(F.coalesce(haversine_km(lat("p.venue"), lon("p.venue"), lat("venue"), lon("venue")), zero), 4).alias("travel_km"),
        F.round(F.coalesce(zone_shift_hours(lon("p.venue"), lon("venue")), zero), 6).alias("tz_shift"),
        F.coalesce(dan, F.lit(False)).cast("int").alias("day_after_night"))


@query("W14", f"""
WITH {EV}, r AS (SELECT user_id, k % 4 + 0.5 AS line, avg(value) / (1.0 + avg(value)) AS p FROM ev GROUP BY 1, 2)
SELECT user_id, CAST(line AS DOUBLE) AS line, round(p, 6) AS p, round(min(p) OVER (PARTITION BY user_id ORDER BY line), 6) AS p_clamped FROM r""")
def monotone_ladder(spark, d):
    r = events(spark, d).groupBy("user_id", (F.col("k") % 4 + F.lit(0.5)).cast("double").alias("line")).agg((F.avg("value") / (1.0 + F.avg("value"))).alias("p"))
    return W.ladder_clamp(r, ["user_id"], "line", "p", "p_clamped").select("user_id", "line", F.round("p", 6).alias("p"), F.round("p_clamped", 6).alias("p_clamped"))


@query("W15", f"""
WITH {PA}, f AS (SELECT game, batter, min((seq, d, batter)) AS o FROM pa GROUP BY 1, 2), lu AS (SELECT game, batter, row_number() OVER (PARTITION BY game ORDER BY o) AS r FROM f),
nine AS (SELECT game, batter, r - 1 AS slot FROM lu WHERE r <= 9)
SELECT a.game, a.batter, CAST(a.slot AS INT) AS slot, b.batter AS on_deck FROM nine a LEFT JOIN nine b ON a.game = b.game AND b.slot = (a.slot + 1) % 9""")
def lineup_on_deck(spark, d):
    """First nine distinct batters of a game; the next slot (cyclic over nine) is on deck."""
    first = appearances(spark, d).groupBy("game", "batter").agg(F.min(F.struct("seq", "d", "batter")).alias("o"))
    lu = top_k(first, ["game"], [F.col("o")], 9, "r").select("game", "batter", (F.col("r") - 1).alias("slot"))
    nxt = lu.select("game", ((F.col("slot") + 8) % 9).alias("slot"), F.col("batter").alias("on_deck"))
    return lu.join(nxt, ["game", "slot"], "left").select("game", "batter", "slot", "on_deck")


@query("W16 A48", f"""
WITH {PA}, s AS (SELECT *, row_number() OVER w AS k, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sub_seq FROM pa
 WINDOW w AS (PARTITION BY game, pitcher % 3 ORDER BY {PA_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
risk AS (SELECT *, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS event FROM s WHERE status = 'O' OR sub_seq = 1)
SELECT least(k, 6) AS k, CAST(pitcher % 3 AS BIGINT) AS slot, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM risk GROUP BY 1, 2""")
def risk_set(spark, d):
    """Rows at risk: the starter's own rows plus the first substitute row (the event)."""
    pa = appearances(spark, d).withColumn("slot", F.col("pitcher") % 3)
    sub = F.when(F.col("status") == "F", 1).otherwise(0)
    s = ordered_scan(pa, ["game", "slot"], ORD, F.col("seq"), [Index("k"), Running("sub_seq", sub)])
    risk = s.filter((F.col("status") == "O") | (F.col("sub_seq") == 1))
    return risk.groupBy(F.least("k", F.lit(6)).cast("long").alias("k"), "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("events"))


@query("W17 A22", f"""
WITH {PA}, m AS (SELECT *, max(seq) OVER (PARTITION BY game, status) AS own_last, max(seq) OVER (PARTITION BY game) AS team_last FROM pa),
h AS (SELECT *, CASE WHEN seq = own_last THEN 1 ELSE 0 END AS removed FROM m WHERE NOT (seq = own_last AND seq = team_last))
SELECT CAST(seq AS INT) AS seq, count(*) AS n, CAST(sum(removed) AS BIGINT) AS removed, round(avg(removed), 6) AS hazard FROM h GROUP BY 1""")
def censored_removal(spark, d):
    """Own last versus team last: the exit is an event only when the side went on; else it is censored."""
    pa = group_totals(group_totals(appearances(spark, d), ["game", "status"], own_last=F.max("seq")), ["game"], team_last=F.max("seq"))
    h = pa.filter(~((F.col("seq") == F.col("own_last")) & (F.col("seq") == F.col("team_last"))))
    rem = (F.col("seq") == F.col("own_last")).cast("int")
    return h.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.sum(rem).alias("removed"), F.round(F.avg(rem), 6).alias("hazard"))


@query("W18", f"""
WITH {GAMES} SELECT game, row_number() OVER (PARTITION BY home, d ORDER BY game) AS game_in_day, count(*) OVER (PARTITION BY home, d) > 1 AS double_header FROM games""")
def double_header_ordinal(spark, d):
    g = games(spark, d).select("game", "home", "d")
    r = ordered_scan(g, ["home", "d"], [F.col("game")], F.floor(F.col("game") / 1000), [Index("game_in_day")])
    return group_totals(r, ["home", "d"], c=F.count(F.lit(1))).select("game", "game_in_day", (F.col("c") > 1).alias("double_header"))


@query("W20 X19", f"""
WITH {LED}, r AS (SELECT market, d, entity, p, row_number() OVER w AS rn, lead(p) OVER w AS p2 FROM led WINDOW w AS (PARTITION BY market, d ORDER BY p DESC, game))
SELECT market, d, entity, round(ln(greatest(least(p, 1-1e-6), 1e-6)) - ln(1 - greatest(least(p, 1-1e-6), 1e-6)) - (CASE WHEN p2 IS NOT NULL THEN ln(greatest(least(p2, 1-1e-6), 1e-6)) - ln(1 - greatest(least(p2, 1-1e-6), 1e-6)) END), 6) AS margin,
 coalesce(ln(greatest(least(p, 1-1e-6), 1e-6)) - ln(1 - greatest(least(p, 1-1e-6), 1e-6)) - (CASE WHEN p2 IS NOT NULL THEN ln(greatest(least(p2, 1-1e-6), 1e-6)) - ln(1 - greatest(least(p2, 1-1e-6), 1e-6)) END) >= 0.25, FALSE) AS clear FROM r WHERE rn = 1""")
def clear_leader(spark, d):
    r = W.clear_leader(ledger(spark, d), ["market", "d"], "p", [F.col("game")])
    return r.select("market", "d", "entity", F.round("margin", 6).alias("margin"), "clear")


@query("W26", f"""
WITH {EV}, t AS (SELECT DISTINCT user_id FROM ev), cal AS (SELECT user_id, DATE '2024-01-10' + CAST(i AS INT) AS d FROM t, (SELECT unnest(generate_series(1, 10)) AS i)),
p AS (SELECT DISTINCT user_id, d FROM ev)
SELECT cal.user_id, min(cal.d) AS off_day FROM cal LEFT JOIN p ON cal.user_id = p.user_id AND cal.d = p.d WHERE p.d IS NULL GROUP BY 1""")
def first_off_day(spark, d):
    return W.first_off_day(events(spark, d), "user_id", "d", "2024-01-10", 10)


@query("ST4", f"""
WITH {EV}, dd AS (SELECT DISTINCT user_id, d FROM ev), r AS (SELECT user_id, d, CASE WHEN date_diff('day', lag(d) OVER w, d) <= 2 THEN 0 ELSE 1 END AS nw FROM dd WINDOW w AS (PARTITION BY user_id ORDER BY d)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY d) AS run FROM r)
SELECT user_id, CAST(run AS BIGINT) AS run, min(d) AS start, max(d) AS "end", count(*) AS n_days FROM g GROUP BY 1, 2""")
def gap_merged_runs(spark, d):
    return W.date_runs(events(spark, d).select("user_id", "d").distinct(), ["user_id"], "d", 2)


@query("ST3 U3", f"""
WITH {EV}, e AS (SELECT user_id, d, event_id, CASE event_type WHEN 'signup' THEN 'place' WHEN 'error' THEN 'transfer' WHEN 'purchase' THEN 'activate' WHEN 'view' THEN 'rehab' END AS kind, k AS days FROM ev WHERE event_type <> 'click'),
g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'activate' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e),
o AS (SELECT user_id, grp, min((d, event_id)) FILTER (WHERE kind IN ('place', 'transfer')) AS op, max(d) FILTER (WHERE kind = 'activate') AS act_date,
  max(CASE WHEN coalesce(days, 0) >= 60 THEN 1 ELSE 0 END) FILTER (WHERE kind IN ('place', 'transfer')) AS il60, max((d, event_id)) FILTER (WHERE kind = 'rehab') AS rh FROM g GROUP BY 1, 2)
SELECT user_id, op[1] AS place_date, act_date, CAST(date_diff('day', op[1], act_date) AS INT) AS stint_days, CAST(il60 AS INT) AS il60, CASE WHEN rh > op THEN 1 ELSE 0 END AS rehab FROM o WHERE op IS NOT NULL""")
def stint_pairing(spark, d):
    e = events(spark, d).filter("event_type <> 'click'")
    t = F.col("event_type")
    kind = F.when(t == "signup", "place").when(t == "error", "transfer").when(t == "purchase", "activate").when(t == "view", "rehab")
    return W.stints(e.withColumn("kind", kind), "user_id", "d", F.col("event_id"), "kind", "k")


@query("L2 D4", f"""
WITH {LED} SELECT market, d, game, round(p, 9) AS p, rn FROM (SELECT *, row_number() OVER (PARTITION BY market, d ORDER BY p DESC, game) AS rn FROM led) WHERE rn <= 3""")
def top_three_per_slate(spark, d):
    return top_k(ledger(spark, d), ["market", "d"], [F.desc("p"), F.asc("game")], 3).select("market", "d", "game", F.round("p", 9).alias("p"), "rn")


@query("L3 W23", """
SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, abs(s_acctbal - 3000) DESC NULLS LAST, s_suppkey) AS rank_pos FROM supplier""")
def multi_key_rank(spark, d):
    """Rank by tier, then by a derived deviation, NULLs last: the rank of a whole table comes from
    range-partitioned positions, not from one global window."""
    from asofkit.operators.ranking import global_rank

    s = table(spark, d, "supplier")
    tier = F.when(F.col("s_acctbal") > 5000, 0).otherwise(1)
    dev = F.abs(F.col("s_acctbal") - 3000)
    return global_rank(s, [tier, F.desc_nulls_last(dev), F.asc("s_suppkey")], F.struct(tier.alias("tier"), (-F.floor(F.coalesce(dev, F.lit(-1.0)))).alias("depth")), "rank_pos").select("s_suppkey", "rank_pos")


@query("S19", f"""WITH {EV} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq_no FROM ev""")
def global_sequence_number(spark, d):
    from asofkit.operators.ranking import global_rank

    e = events(spark, d)
    return global_rank(e, [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "seq_no").select("event_id", "seq_no")


@query("L5", """SELECT o_orderkey FROM (SELECT o_orderkey, (((o_orderkey * 1103515245 + 3 * 12345 + 7) % 2147483648) * 69069 + 1) % 2147483648 AS h FROM orders WHERE year(o_orderdate) = 1998)
 ORDER BY (h * 1103515245 + 12345) % 2147483648, o_orderkey LIMIT 60""")
def seeded_sample(spark, d):
    """The sixty games of a season with the smallest seeded hash; a sample that any rerun repeats."""
    from asofkit.functions.hashing import mix

    o = table(spark, d, "orders").filter(F.year("o_orderdate") == 1998)
    return o.orderBy(mix(F.col("o_orderkey"), F.lit(3), 7), "o_orderkey").limit(60).select("o_orderkey")


@query("L6", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def span_limit(spark, d):
    o = table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate")).filter("d BETWEEN DATE'1998-03-01' AND DATE'1998-06-30'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "d")


