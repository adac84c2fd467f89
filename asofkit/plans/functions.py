"""Scalar, array and map functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import labels as L
from asofkit.functions import physics as Y
from asofkit.functions import prob as P
from asofkit.functions import rules as R
from asofkit.functions import text as T
from asofkit.functions import timefn as D
from asofkit.functions import vectors as V
from asofkit.plans._roles import EV, GAMES, LED, PA, appearances, events, games, ledger, table
from asofkit.plans.evaluation import logit_sql, r6
from asofkit.plans._roles import prob_sql
from asofkit.registry import query


@query("P1 X3", """SELECT c_custkey, try_cast(v AS DOUBLE) AS num, CASE WHEN v IS NULL OR trim(v) IN ('', 'nan') THEN '' WHEN try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE)) THEN CAST(CAST(try_cast(v AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN CAST(try_cast(v AS DOUBLE) AS VARCHAR) ELSE trim(v) END AS key
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey || '.0' WHEN 1 THEN ' x' || c_custkey WHEN 2 THEN '' WHEN 3 THEN (c_custkey % 100) || '.50' END AS v FROM customer)""")
def lenient_numbers(spark, d):
    k = F.col("c_custkey")
    s = k.cast("string")
    v = F.when(k % 5 == 0, F.concat(s, F.lit(".0"))).when(k % 5 == 1, F.concat(F.lit(" x"), s)).when(k % 5 == 2, "").when(k % 5 == 3, F.concat((k % 100).cast("string"), F.lit(".50")))
    return table(spark, d, "customer").withColumn("v", v).select("c_custkey", P.num("v").alias("num"), T.key_text("v").alias("key"))


EVN = "['strikeout','walk','single','home_run','field_out','stolen_base','double','hit_by_pitch']"


@query("P2 P3 P4", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE e WHEN 'strikeout' THEN 'K' WHEN 'walk' THEN 'BB' WHEN 'single' THEN '1B' WHEN 'home_run' THEN 'HR' WHEN 'field_out' THEN 'IPO' WHEN 'double' THEN '2B' ELSE 'HBP' END AS label,
 CASE WHEN e NOT IN ('strikeout', 'walk', 'hit_by_pitch') AND bt <> 'bunt' THEN bt END AS ball, CAST((l_suppkey % 2)::INT + CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 5 = 0 THEN 4 ELSE 0 END AS INT) AS state, CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE l_partkey END AS bat_team, (l_linestatus = 'F')::INT AS home_bat
FROM (SELECT *, ({EVN})[1 + l_partkey % 8] AS e, (['ground_ball','fly_ball','bunt'])[1 + l_suppkey % 3] AS bt FROM lineitem) WHERE e <> 'stolen_base'""")
def outcome_classes(spark, d):
    """Terminal events to classes (others drop out), ball type in play only, base mask and batting side."""
    li = table(spark, d, "lineitem")
    ev = F.array(*[F.lit(x) for x in ("strikeout", "walk", "single", "home_run", "field_out", "stolen_base", "double", "hit_by_pitch")])
    bt = F.array(*[F.lit(x) for x in ("ground_ball", "fly_ball", "bunt")])
    s = F.col("l_suppkey")
    li = li.withColumn("e", F.get(ev, (F.col("l_partkey") % 8).cast("int"))).withColumn("bt", F.get(bt, (s % 3).cast("int"))).withColumn("label", L.outcome_class("e")).filter("label IS NOT NULL")
    on = lambda c: F.when(c, s)
    top = F.col("l_linestatus") == "F"
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "label", L.ball_type("e", "bt").alias("ball"), L.base_mask(on(s % 2 == 1), on(s % 3 == 0), on(s % 5 == 0)).alias("state"),
                     F.when(top, s).otherwise(F.col("l_partkey")).alias("bat_team"), top.cast("int").alias("home_bat"))


@query("P5 J21", f"""WITH {GAMES}, al AS (SELECT 3 AS code, 103 AS canon, 1995 AS y0, 1997 AS y1 UNION ALL SELECT 3, 203, 1998, 2100 UNION ALL SELECT 7, 107, 1999, 2100)
SELECT game, coalesce(al.canon, home) AS franchise FROM games LEFT JOIN al ON home = code AND season BETWEEN y0 AND y1""")
def season_recode(spark, d):
    """Codes that changed hands: the right one depends on the season."""
    al = spark.createDataFrame([(3, 103, 1995, 1997), (3, 203, 1998, 2100), (7, 107, 1999, 2100)], "code long, canon long, y0 int, y1 int")
    g = games(spark, d)
    j = g.join(al, (F.col("home") == F.col("code")) & F.col("season").between(F.col("y0"), F.col("y1")), "left")
    return j.select("game", F.coalesce("canon", "home").alias("franchise"))


_BOX = """SELECT l_orderkey AS game, count(*) AS pa, count(*) FILTER (WHERE l_returnflag = 'R') AS h, 0 AS b2, count(*) FILTER (WHERE l_quantity > 48) AS b3, count(*) FILTER (WHERE l_discount > 0.09) AS hr, count(*) FILTER (WHERE l_returnflag = 'A') AS tb,
 count(*) FILTER (WHERE l_linestatus = 'F') AS r, count(*) FILTER (WHERE l_tax > 0.06) AS rbi, count(*) FILTER (WHERE l_tax = 0) AS bb, count(*) FILTER (WHERE l_discount = 0) AS sb, count(*) FILTER (WHERE l_linenumber = 7) AS so FROM lineitem GROUP BY 1"""


def _stat_lines(spark, d):
    c = lambda e: F.count_if(F.expr(e))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(
        F.count(F.lit(1)).alias("pa"), c("l_returnflag = 'R'").alias("h"), F.lit(0).alias("b2"), c("l_quantity > 48").alias("b3"), c("l_discount > 0.09").alias("hr"), c("l_returnflag = 'A'").alias("tb"),
        c("l_linestatus = 'F'").alias("r"), c("l_tax > 0.06").alias("rbi"), c("l_tax = 0").alias("bb"), c("l_discount = 0").alias("sb"), c("l_linenumber = 7").alias("so"))


@query("P6 S16", f"""WITH b AS ({_BOX}) SELECT game, market, y FROM ({' UNION ALL '.join(f"SELECT game, '{m}' AS market, ({e})::INT AS y FROM b" for m, e in L.BATTER_EVENTS.items())})""")
def binary_markets(spark, d):
    """All batter events of a stat line, one row each."""
    return _stat_lines(spark, d).select("game", F.explode(L.batter_events()).alias("e")).select("game", "e.market", "e.y")


LABELS_ = ["1+ HR", "2+ total bases", "2+ H+R+RBI", "1+ single", "2+ RBI", "run scored", "1+ walk", "stolen base", "2+ hits", "K > 6.5", "Outs > 17.5", "Runs > x"]


@query("P7", f"""WITH b AS ({_BOX}), l AS (SELECT *, ({LABELS_})[1 + game % 12] AS label FROM b)
SELECT game, label, CASE WHEN label LIKE '%>%' THEN try_cast(trim(split_part(label, '>', -1)) AS DOUBLE) END AS line, CASE label WHEN 'K > 6.5' THEN 'so' WHEN 'Outs > 17.5' THEN 'outs' END AS stat,
 CASE WHEN label LIKE '%H+R+RBI%' THEN h + r + rbi WHEN label LIKE '%total bases%' THEN tb WHEN label LIKE '%HR%' THEN hr WHEN label LIKE '%RBI%' THEN rbi WHEN label LIKE '%single%' THEN h - b2 - b3 - hr WHEN label LIKE '%double%' THEN b2
  WHEN label LIKE '%hit%' THEN h WHEN label LIKE '%run%' THEN r WHEN label LIKE '%walk%' THEN bb WHEN label LIKE '%stolen base%' THEN sb END AS actual FROM l""")
def label_parsing(spark, d):
    b = _stat_lines(spark, d).withColumn("label", F.get(F.array(*[F.lit(x) for x in LABELS_]), (F.col("game") % 12).cast("int")))
    return b.select("game", "label", L.line_of("label").alias("line"), L.line_stat("label").alias("stat"), L.label_actual("label").alias("actual"))


MARKETS = [*L.NAME_OF_ONE, "batter_total_bases", "batter_rbis", "batter_hits_runs_rbis", *L.NAME_OF_PITCHER, "batter_triples"]


@query("P7", f"""WITH {PA}, m AS (SELECT ({MARKETS})[1 + game % {len(MARKETS)}] AS market, CAST(qty AS INT) % 7 + 0.5::DOUBLE AS line, CAST(qty AS INT) % 7 + 1 AS n FROM pa)
SELECT market, line, CASE market WHEN 'batter_walks' THEN '1+ walk' WHEN 'batter_stolen_bases' THEN 'stolen base' WHEN 'batter_doubles' THEN '1+ double' WHEN 'batter_total_bases' THEN n || '+ total bases' WHEN 'batter_rbis' THEN n || '+ RBI'
  WHEN 'batter_hits_runs_rbis' THEN n || '+ H+R+RBI' WHEN 'batter_hits' THEN CASE n WHEN 1 THEN '1+ hit' ELSE n || '+ hits' END WHEN 'batter_home_runs' THEN n || '+ HR' WHEN 'batter_runs_scored' THEN CASE n WHEN 1 THEN 'run scored' ELSE n || '+ runs scored' END
  WHEN 'batter_singles' THEN CASE n WHEN 1 THEN '1+ single' ELSE n || '+ singles' END WHEN 'batter_triples' THEN market ELSE 'pitcher ' || replace(replace(market, 'pitcher_', ''), '_', ' ') || ' o' || line END AS shown,
 CASE market WHEN 'pitcher_outs' THEN 'Outs > ' || line END AS ladder, CASE market WHEN 'pitcher_outs' THEN line END AS parsed, CASE market WHEN 'pitcher_outs' THEN 'outs' END AS stat, count(*) AS n FROM m GROUP BY ALL""")
def market_names(spark, d):
    """Names built from market and line, and ladder labels read back to the line and stat they came from."""
    names = F.array(*[F.lit(x) for x in MARKETS])
    m = appearances(spark, d).select(F.get(names, (F.col("game") % len(MARKETS)).cast("int")).alias("market"), (F.col("qty").cast("int") % 7 + 0.5).cast("double").alias("line"))
    m = m.groupBy("market", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("ladder", L.market_label("market", "line"))
    return m.select("market", "line", L.shown_name("market", "line").alias("shown"), "ladder", L.line_of("ladder").alias("parsed"), L.line_stat("ladder").alias("stat"), "n")


@query("P10", f"""WITH {LED} SELECT family, count(*) AS n FROM led WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND d NOT IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY 1""")
def quarantined_dates(spark, d):
    bad = spark.createDataFrame([("2024-01-10",), ("2024-01-11",)], "d string").select(F.col("d").cast("date").alias("d"))
    led = ledger(spark, d).filter("d BETWEEN DATE'2024-01-05' AND DATE'2024-01-25'").join(bad, "d", "left_anti")
    return led.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("P12 X10 X28", """SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS season, month(o_orderdate) >= 10 AS post, round(date_diff('day', DATE '1970-06-15', CAST(o_orderdate AS DATE)) / 365.25, 6) AS age,
 CAST(year(o_orderdate) - 1995 AS INT) AS season_idx, (CAST(o_orderdate AS DATE) >= DATE '1998-06-21')::INT AS era, round(power(0.5, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365.25 / 2.0), 8) AS w FROM orders""")
def season_and_era(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", D.season_of(day).alias("season"), D.postseason(day).alias("post"), F.round(D.age_years(day, F.lit("1970-06-15").cast("date")), 6).alias("age"),
        (F.year(day) - 1995).alias("season_idx"), (day >= F.lit("1998-06-21").cast("date")).cast("int").alias("era"),
        F.round(P.recency_weight(F.datediff(F.lit("2001-08-01").cast("date"), day), 2.0), 8).alias("w"))


@query("X4 X5 X7 X16", """WITH w AS (SELECT o_orderkey, CAST(40 + o_orderkey % 60 AS INT) AS temp, CAST(o_orderkey % 25 AS INT) AS spd, (['Out To CF','In From LF','L To R','Out To RF','Calm'])[1 + o_orderkey % 5] AS dir, (['Partly Cloudy','Dome','Roof Closed','Sunny'])[1 + o_orderkey % 4] AS cond, CAST(300 + o_orderkey % 40 AS INT) AS lf, CAST(70 + o_orderkey % 9 AS INT) AS ht, o_orderkey % 2 = 0 AS rh FROM orders),
f AS (SELECT *, cond IN ('Dome', 'Roof Closed') AS dome, CASE dir WHEN 'Out To CF' THEN 1.0 WHEN 'In From LF' THEN -0.8 WHEN 'Out To RF' THEN 0.8 ELSE 0.0 END AS rad, CASE dir WHEN 'Out To CF' THEN 1.0 WHEN 'In From LF' THEN -1.0 WHEN 'Out To RF' THEN 1.0 ELSE 0.0 END AS sgn,
 CASE dir WHEN 'Out To CF' THEN 0.7 WHEN 'In From LF' THEN CASE WHEN rh THEN 1.0 ELSE 0.2 END WHEN 'Out To RF' THEN CASE WHEN rh THEN 0.2 ELSE 1.0 END ELSE 0.0 END AS wt FROM w)
SELECT o_orderkey, temp, cond, spd, dir, dome, lf, ht, CAST(CASE WHEN dome THEN 0 ELSE round(spd * rad, 6) END AS DOUBLE) AS wind_out, CAST(CASE WHEN dome THEN 0 ELSE round(spd * sgn * wt * 0.3, 6) END AS DOUBLE) AS wind_pull, round(1013.25 / ((temp - 32) * 5.0 / 9 + 273.15), 8) AS air, CAST(330.0 - lf AS DOUBLE) AS porch FROM f""")
def weather_and_park(spark, d):
    """Text fields parsed back out of their report lines, then physics over them."""
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    s = lambda c: c.cast("string")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.concat(s(40 + k % 60), F.lit(" degrees, "), pick(["Partly Cloudy", "Dome", "Roof Closed", "Sunny"], 4), F.lit(".")).alias("weather"),
        F.concat(s(k % 25), F.lit(" mph, "), pick(["Out To CF", "In From LF", "L To R", "Out To RF", "Calm"], 5), F.lit(".")).alias("wind"),
        F.concat(F.lit("325-R, 400-C, "), s(300 + k % 40), F.lit("-L")).alias("dims"), F.concat(s(F.floor((70 + k % 9) / 12)), F.lit("' "), s((70 + k % 9) % 12), F.lit('"')).alias("height"))
    o = o.select("o_orderkey", T.weather_temp("weather").alias("temp"), T.weather_condition("weather").alias("cond"), T.wind_speed("wind").alias("spd"), T.wind_direction("wind").alias("dir"),
                 T.dimension("dims", "L").alias("lf"), T.height_inches("height").alias("ht"), (k % 2 == 0).alias("rh"))
    o = o.withColumn("dome", T.roof_closed("cond"))
    return o.select("o_orderkey", "temp", "cond", "spd", "dir", "dome", "lf", "ht", F.round(Y.wind_out("spd", "dir", "dome"), 6).alias("wind_out"),
                    F.round(Y.wind_pull("spd", "dir", "rh", "dome", F.lit(0.3)), 6).alias("wind_pull"), F.round(Y.air_density(F.lit(1013.25), "temp"), 8).alias("air"), Y.porch("lf").alias("porch"))


@query("X6 X8 X9", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'over' WHEN event_id % 3 = 1 THEN 'under' END AS side, strftime(ts, '%H:%M') AS clock, CASE WHEN hour(ts) < 17 THEN 'day' ELSE 'night' END AS daynight, CAST(ts - INTERVAL 5 HOUR AS DATE) AS slate,
 CASE WHEN user_id % 3 = 0 THEN 'BOS' WHEN user_id % 3 = 1 THEN 'CWS' END AS code FROM events""")
def labels_and_clocks(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    lab = F.when(k % 6 == 0, " Over").when(k % 3 == 0, "YES").when(k % 6 == 1, "under ").when(k % 3 == 1, "No").otherwise("maybe")
    club = F.when(F.col("user_id") % 3 == 0, "Boston Red Sox").when(F.col("user_id") % 3 == 1, "Chicago White Sox").otherwise("Nowhere Nine")
    clock = D.clock_24h(F.date_format("ts", "h:mm a 'ET'"))
    return e.select("event_id", T.bet_side(lab).alias("side"), clock.alias("clock"), D.day_or_night(clock).alias("daynight"), D.slate_date("ts").alias("slate"),
                    L.nickname_code(club, {"Sox": "SOX", "Red Sox": "BOS", "White Sox": "CWS"}).alias("code"))


@query("X11 X12 X13 X14 X15", """WITH a AS (SELECT *, l_quantity - 25 AS px, l_discount * 30 AS pz FROM lineitem), b AS (SELECT *, greatest(abs(px / 20) / 0.83, abs(pz - 2.5) / 1.0) AS loc, degrees(atan2(l_quantity * 5 - 125.42, 198.27 - l_tax * 1000)) AS ang FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(floor(l_quantity / 10) * 3 + round((l_quantity / 10 - floor(l_quantity / 10)) * 10) AS BIGINT) AS outs, round(2 * 6371.0 * asin(sqrt(power(sin(radians(l_tax * 100) / 2), 2) + cos(radians(30.0)) * cos(radians(30.0 + l_tax * 100)) * power(sin(radians(l_discount * 100) / 2), 2))), 4) AS km,
 round(loc, 6) AS loc, loc > 0.67 AND loc <= 1.33 AS shadow, round(ang, 6) AS angle, CASE WHEN l_suppkey % 2 = 0 THEN ang < -15 ELSE ang > 15 END AS pulled,
 round((l_quantity + 3 + 1 - 2) * (1.1 * (1.4 * (l_quantity + 8) - 0.6 * l_quantity - 3.0 * 2 + 0.1 * 4)) / greatest(1.1 * (1.4 * (l_quantity + 8) - 0.6 * l_quantity - 3.0 * 2 + 0.1 * 4) + greatest(90 - l_quantity, 1.0), 1e-9) + 2, 6) AS runs,
 CASE WHEN l_linenumber % 4 = 0 AND l_suppkey % 3 = 0 THEN 'first' WHEN l_linenumber % 4 = 3 AND l_suppkey % 3 = 2 THEN 'full' WHEN l_suppkey % 3 > l_linenumber % 4 THEN 'ahead' WHEN l_linenumber % 4 > l_suppkey % 3 THEN 'behind' ELSE 'even' END AS cs FROM b""")
def geometry_and_zone(spark, d):
    q, h = F.col("l_quantity"), F.lit(30.0)
    ang = Y.spray_angle(q * 5, F.col("l_tax") * 1000)
    loc = Y.zone_location((q - 25) / 20, F.col("l_discount") * 30, F.lit(3.5), F.lit(1.5))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", Y.ip_to_outs(q / 10).alias("outs"),
        F.round(Y.haversine_km(h, F.lit(-70.0), h + F.col("l_tax") * 100, F.lit(-70.0) + F.col("l_discount") * 100), 4).alias("km"),
        F.round(loc, 6).alias("loc"), Y.shadow_band(loc).alias("shadow"), F.round(ang, 6).alias("angle"), Y.pulled(ang, F.col("l_suppkey") % 2 == 0).alias("pulled"),
        F.round(Y.base_runs(q, F.lit(3), F.lit(1), q + 8, F.lit(2), F.lit(90)), 6).alias("runs"), Y.count_state(F.col("l_linenumber") % 4, F.col("l_suppkey") % 3).alias("cs"))


@query("X19 X20 X21", f"""WITH {LED} SELECT game, round({logit_sql('p')}, 6) AS z, round(1 / (1 + exp(-(0.1 + 0.8 * {logit_sql('p')}))), 6) AS platt, round(1 / (1 + exp(-(0.5 * {logit_sql('p')} + 0.5 * {logit_sql('0.4')}))), 6) AS blend,
 round(1 / (1 + exp(-({logit_sql('0.3')} + (1 / (1 + 0.25)) * ({logit_sql('p')} - {logit_sql('0.3')})))), 6) AS shrunk, round((entity + 50.0 * 0.3) / (entity * 2 + 50.0), 6) AS eb, round(greatest(entity * p / (entity * 2 + 1) - power(p / 2, 2), 0), 6) AS var FROM led""")
def probability_functions(spark, d):
    e = F.col("entity")
    led = ledger(spark, d)
    r = led.select("game", P.logit("p").alias("z"), P.platt("p", F.lit(0.1), F.lit(0.8)).alias("platt"), P.logit_blend("p", F.lit(0.4)).alias("blend"), P.anchor_shrink("p", F.lit(0.5), F.lit(0.3)).alias("shrunk"),
                   P.eb_rate(e, e * 2, F.lit(0.3), F.lit(50.0)).alias("eb"), P.clip(e * F.col("p") / (e * 2 + 1) - F.pow(F.col("p") / 2, 2), 0.0).alias("var"))
    return r6(r, "game")


@query("X20 M9", f"""WITH {PA}, c AS (SELECT pitcher, season, count(*) AS n, count(*) FILTER (WHERE label = 'cA') AS a, count(*) FILTER (WHERE label = 'cR') AS r FROM pa GROUP BY 1, 2)
SELECT pitcher, season, round((a + 60.0 * CASE WHEN n < 80 AND pitcher % 3 = 0 THEN 0.2 ELSE 0.33 END) / (n + 60.0), 6) AS "cA_rate", round((r + 90.0 * 0.33) / (n + 90.0), 6) AS "cR_rate", round(ln(1 + n), 6) AS log_n FROM c""")
def shrunk_class_rates(spark, d):
    """Class rates with a personal prior standing in while the sample is thin."""
    from asofkit.operators.shrink import class_counts

    c = class_counts(appearances(spark, d), ["pitcher", "season"], "label", ["cA", "cR"])
    own = {"cA": F.when(F.col("pitcher") % 3 == 0, 0.2)}
    cols = P.shrunk_rates(["cA", "cR"], {k: F.col(k) for k in ("cA", "cR")}, F.col("n"), {k: F.lit(0.33) for k in ("cA", "cR")}, {"cA": F.lit(60.0), "cR": F.lit(90.0)}, own_priors=own, min_own=80)
    return r6(c.select("pitcher", "season", *cols), "pitcher", "season")


@query("X23", f"""WITH {LED}, t AS (SELECT game, p, (1 - p) * 0.5 AS g1, (1 - p) * 0.5 AS g2, p AS gi, 0.6 AS k1, 0.4 AS k2 FROM led)
SELECT game, round(g1, 6) AS c1, round(g2, 6) AS c2, round(gi * (k1 * p + k2 * 0.2), 6) AS c3, round(gi * (k1 * (1 - p) + k2 * 0.8), 6) AS c4, round(k1 * p / (k1 * p + k2 * 0.2), 6) AS k1_given_c3 FROM t""")
def tree_composition(spark, d):
    p = F.col("p")
    t = ledger(spark, d).select("game", F.array((1 - p) * 0.5, (1 - p) * 0.5, p).alias("g"), F.array(F.lit(0.6), F.lit(0.4)).alias("k"),
                                F.array(F.array(p, 1 - p), F.array(F.lit(0.2), F.lit(0.8))).alias("o"))
    v, c = V.tree_compose("g", "k", "o"), V.kind_given_outcome("k", "o")
    return r6(t.select("game", *[F.element_at(v, i).alias(f"c{i}") for i in range(1, 5)], F.element_at(F.element_at(c, 1), 1).alias("k1_given_c3")), "game")


@query("X24 X25 M14", f"""WITH {LED}, m AS (SELECT game, p, p * 0.5 AS a1, 1 - p * 0.5 AS a2, p * 0.8 AS b1, 1 - p * 0.8 AS b2 FROM led), g AS (SELECT *, sqrt(a1 * b1) AS u1, sqrt(a2 * b2) AS u2, ln(greatest(least(a1, 1 - 1e-12), 1e-12) / (1 - greatest(least(a1, 1 - 1e-12), 1e-12))) AS z1, ln(greatest(least(b1, 1 - 1e-12), 1e-12) / (1 - greatest(least(b1, 1 - 1e-12), 1e-12))) AS z2 FROM m)
SELECT game, round((a1 + b1) / 2, 6) AS mean1, round(u1 / (u1 + u2), 6) AS geo1, round(abs(z1 - z2) / 2, 6) AS sd1, round(a1 * exp(0.4 * p) / (a1 * exp(0.4 * p) + a2), 6) AS tilt1 FROM g""")
def member_blends(spark, d):
    """Mean and geometric blends of member vectors, their logit spread and an exponential tilt."""
    p = F.col("p")
    t = ledger(spark, d).select("game", "p", F.array(F.array(p * 0.5, 1 - p * 0.5), F.array(p * 0.8, 1 - p * 0.8)).alias("m"))
    one = lambda c: F.element_at(c, 1)
    return r6(t.select("game", one(V.blend_mean("m")).alias("mean1"), one(V.blend_geometric("m")).alias("geo1"), V.member_logit_std("m", 1).alias("sd1"),
                       one(V.class_tilt(F.element_at("m", 1), [0.4, 0.0], p)).alias("tilt1")), "game")


@query("X25", f"""WITH {PA}, c AS (SELECT season AS k, label, count(*) AS n FROM pa GROUP BY 1, 2), t AS (SELECT *, CASE label WHEN 'cA' THEN 0 WHEN 'cN' THEN 1 ELSE 2 END AS b FROM c), w AS (SELECT *, n * exp(0.3 * (b - 1)) AS e FROM t)
SELECT CAST(k AS INT) AS k, label, round(e / sum(e) OVER (PARTITION BY k), 6) AS p FROM w""")
def bucketed_tilt(spark, d):
    """Discrete distribution tilted by its bucket and renormalised within the key."""
    from asofkit.operators.scan import group_totals

    c = appearances(spark, d).groupBy(F.col("season").alias("k"), "label").agg(F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("label") == "cA", 0).when(F.col("label") == "cN", 1).otherwise(2)
    t = group_totals(c.withColumn("e", F.col("n") * F.exp(0.3 * (b - 1))), ["k"], s=F.sum("e"))
    return t.select("k", "label", F.round(F.col("e") / F.col("s"), 6).alias("p"))


@query("X26", f"""WITH {PA}, v AS (SELECT pitcher, season, avg(disc) AS v FROM pa GROUP BY 1, 2) SELECT o_orderkey, round(coalesce(v.v, 0.05), 6) AS v FROM orders LEFT JOIN v ON v.pitcher = o_orderkey % 100 AND v.season = year(o_orderdate)""")
def keyed_value_lookup(spark, d):
    """A (season, entity) value map: the season map of an entity as one map column, looked up per row."""
    v = appearances(spark, d).groupBy("pitcher", "season").agg(F.avg("disc").alias("v"))
    m = v.groupBy("pitcher").agg(F.map_from_entries(F.collect_list(F.struct("season", "v"))).alias("m"))
    o = table(spark, d, "orders").withColumn("pitcher", F.col("o_orderkey") % 100).join(m, "pitcher", "left")
    return o.select("o_orderkey", F.round(F.coalesce(F.try_element_at("m", F.year("o_orderdate")), F.lit(0.05)), 6).alias("v"))


@query("X27", """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, event_type || ':' || user_id || ';' || event_type || ':' || (user_id + 1) AS credits, CAST(2 AS INT) AS n_credits, user_id + 1 AS second FROM events""")
def json_and_packing(spark, d):
    """Props out of JSON; a list of structs packed to text and unpacked again."""
    e = table(spark, d, "events")
    cred = F.array(F.struct(F.col("event_type").alias("credit"), F.col("user_id").alias("id")), F.struct(F.col("event_type").alias("credit"), (F.col("user_id") + 1).alias("id")))
    packed = F.array_join(F.transform(cred, lambda c: F.concat_ws(":", c["credit"], c["id"].cast("string"))), ";")
    back = F.transform(F.split(packed, ";"), lambda s: F.element_at(F.split(s, ":"), 2).cast("long"))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), packed.alias("credits"), F.size(back).alias("n_credits"), F.element_at(back, 2).alias("second"))


@query("X29", f"""WITH {EV}, g AS (SELECT d, count(*) AS n_ev, count(*) FILTER (WHERE event_type = 'error') AS fail, count(*) FILTER (WHERE event_type = 'view') AS rows, day(d) AS dd FROM ev GROUP BY 1)
SELECT d, CASE WHEN n_ev > 0 AND fail > 0 AND (fail >= n_ev OR rows = 0) THEN 'FAILED' WHEN n_ev > 0 AND dd % 7 = 0 THEN 'DEGRADED bulk' WHEN n_ev > 0 AND rows = 0 THEN 'DEGRADED empty' WHEN fail > 0 THEN 'DEGRADED partial' ELSE 'OK' END AS capture,
 CASE WHEN dd % 5 = 0 THEN CASE WHEN dd % 3 = 0 THEN 'REFUSE unknown' WHEN dd % 2 = 0 THEN 'REFUSE empty' ELSE 'OK off-day' END WHEN dd % 3 <> 0 AND dd % 5 < dd % 2 * 4 THEN 'OK short' ELSE 'OK' END AS slate FROM g""")
def rule_ladders(spark, d):
    ev = events(spark, d)
    g = ev.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("fail"), F.count_if(F.col("event_type") == "view").alias("rows"))
    dd = F.day("d")
    return g.select("d", R.capture_verdict("n", "fail", "rows", dd % 7 == 0).alias("capture"), R.slate_floor(dd % 5, F.when(dd % 3 != 0, F.when(dd % 5 == 0, (dd + 1) % 2).otherwise(dd % 2 * 4))).alias("slate"))


@query("U6 P7 X17 X19", f"""WITH {LED}, t AS (SELECT game, p, entity, CAST(entity % 9 AS DOUBLE) + 0.5 AS line, CAST((game % 7 - 3) * 55 AS DOUBLE) AS price, CAST(110 - game % 5 * 60 AS DOUBLE) AS back FROM led)
SELECT game, round({prob_sql('price')}, 6) AS implied, round({prob_sql('price')} / ({prob_sql('price')} + {prob_sql('back')}), 6) AS fair, round({logit_sql('p')}, 6) AS z, round(1 / (1 + exp(-(0.1 + 0.8 * {logit_sql('p')}))), 6) AS platt,
 round((entity + 50.0 * 0.3) / (entity * 2 + 50.0), 6) AS eb, 'K > ' || CAST(line AS VARCHAR) AS label, line FROM t""")
def sql_functions(spark, d):
    """The scalar functions called by name from SQL expressions; labels are built and read back."""
    from asofkit.functions.sql import register

    register(spark)
    t = ledger(spark, d).selectExpr("game", "p", "entity", "entity % 9 + 0.5D AS line0", "CAST((game % 7 - 3) * 55 AS DOUBLE) AS price", "CAST(110 - game % 5 * 60 AS DOUBLE) AS back")
    return t.selectExpr("game", "round(implied_prob(price), 6) AS implied", "round(fair_over(price, back), 6) AS fair", "round(log_odds(p), 6) AS z", "round(platt_map(p, 0.1D, 0.8D), 6) AS platt",
                        "round(shrunk_rate(entity, entity * 2, 0.3D, 50.0D), 6) AS eb", "line_text('K', line0) AS label", "line_number(line_text('K', line0)) AS line")
