"""As-of features, shrinkage and prior-season effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.prob import eb_rate, ratio_floor
from asofkit.operators import shrink as S
from asofkit.operators.asof import asof_join, asof_time_join, audit_leakage, decayed_panel, multi_panel_asof
from asofkit.plans._roles import EV, EVENT_CLASSES, GAMES, LABELS, PA, appearances, events, games
from asofkit.registry import query

CNT = ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') AS BIGINT) AS {c}" for c in EVENT_CLASSES)
DAILY = f"daily AS (SELECT user_id, d, count(*) AS n, {CNT} FROM ev GROUP BY 1, 2)"


def panel_sql(src: str, key: str, stats: list[str], hl: float, name: str = "panel") -> str:
    keys = key.split(",")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys)
    sel = ", ".join(f"a.{k.strip()}" for k in keys)
    sums = ", ".join(f"sum(b.{s} * power(2.0, -date_diff('day', b.d, a.d) / {hl}e0)) AS {s}_d" for s in stats)
    return f"{name} AS (SELECT {sel}, a.d, {sums} FROM {src} a JOIN {src} b ON {on} AND b.d <= a.d GROUP BY {sel}, a.d)"


def _daily(spark, d):
    return S.class_counts(events(spark, d), ["user_id", "d"], "event_type", EVENT_CLASSES)


HL = 7.0


@query("A1 W1 J3 A6 X20 A50 P12", f"""
WITH {EV}, {DAILY}, {panel_sql('daily', 'user_id', ['n', 'purchase'], HL)},
lg AS (SELECT CAST(month(d) AS INT) AS m, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) AS r FROM ev GROUP BY 1),
tot AS (SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) AS r FROM ev)
SELECT e.event_id, e.user_id, e.d,
  round(p.purchase_d * power(2.0, -date_diff('day', p.d, e.d) / {HL}e0), 6) AS purchase_d,
  round((coalesce(p.purchase_d * power(2.0, -date_diff('day', p.d, e.d) / {HL}e0), 0)
     + 50.0 * coalesce(lg.r, tot.r)) / (coalesce(p.n_d * power(2.0, -date_diff('day', p.d, e.d) / {HL}e0), 0) + 50.0), 6) AS purchase_rate
FROM ev e ASOF LEFT JOIN panel p ON e.user_id = p.user_id AND e.d > p.d
LEFT JOIN lg ON lg.m + 1 = CAST(month(e.d) AS INT) CROSS JOIN tot""")
def asof_decayed_rate(spark, d):
    """Purchase rate of a user strictly before each event, decayed and shrunk to the prior period's share."""
    ev = events(spark, d)
    panel = decayed_panel(_daily(spark, d), ["user_id"], ["n", "purchase"], HL)
    j = asof_join(ev, panel, ["user_id"], ["n_d", "purchase_d"], half_life=HL)
    hit = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    lg = ev.groupBy((F.month("d") + 1).alias("m")).agg(F.avg(hit).alias("r"))
    total = ev.agg(F.avg(hit)).scalar()
    j = j.withColumn("m", F.month("d")).join(lg, "m", "left")
    prior = F.coalesce(F.col("r"), total)
    return j.select("event_id", "user_id", "d", F.round("purchase_d", 6).alias("purchase_d"),
                    F.round(eb_rate(F.col("purchase_d"), F.col("n_d"), prior, 50.0), 6).alias("purchase_rate"))


@query("A1 P2", f"""WITH {EV} SELECT user_id, d, k % 3 AS split, count(*) AS n, {CNT} FROM ev GROUP BY 1, 2, 3""")
def daily_class_counts(spark, d):
    e = events(spark, d).withColumn("split", F.col("k") % 3)
    return S.class_counts(e, ["user_id", "d", "split"], "event_type", EVENT_CLASSES)


PANELS = {"slow": 30.0, "fast": 3.0, "career": 36500.0}


@query("W1 A52", f"""
WITH {EV}, daily AS (SELECT user_id, d, count(*) AS n, sum(value) AS v, sum(value * value) AS vv FROM ev GROUP BY 1, 2),
{panel_sql('daily', 'user_id', ['n', 'v', 'vv'], 30.0, 'slow')}, {panel_sql('daily', 'user_id', ['n', 'v', 'vv'], 3.0, 'fast')},
{panel_sql('daily', 'user_id', ['n', 'v', 'vv'], 36500.0, 'career')}, a AS (
SELECT 'slow' AS panel, * FROM slow UNION ALL SELECT 'fast', * FROM fast UNION ALL SELECT 'career', * FROM career)
SELECT panel, user_id, d, round(n_d, 6) AS n_d, round(v_d, 6) AS v_d, round(vv_d, 6) AS vv_d FROM a""")
def decayed_panels_by_half_life(spark, d):
    """One daily aggregate, several half-lives, with squared sums for later variances."""
    daily = events(spark, d).groupBy("user_id", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.sum(F.col("value") * F.col("value")).alias("vv"))
    out = None
    for name, hl in PANELS.items():
        p = decayed_panel(daily, ["user_id"], ["n", "v", "vv"], hl).select(
            F.lit(name).alias("panel"), "user_id", "d", *[F.round(c, 6).alias(c) for c in ("n_d", "v_d", "vv_d")])
        out = p if out is None else out.unionByName(p)
    return out


@query("A5 A52 W1", f"""
WITH {PA}, daily AS (SELECT batter, pitcher, d, count(*) AS n, count(*) FILTER (WHERE price >= 50000) AS hard,
  count(*) FILTER (WHERE price >= 80000 AND disc <= 0.05) AS barrel, sum(price) AS xw FROM pa GROUP BY 1, 2, 3),
b AS (SELECT batter, d, sum(n) AS n, sum(hard) AS hard, sum(barrel) AS barrel, sum(xw) AS xw FROM daily GROUP BY 1, 2),
{panel_sql('b', 'batter', ['n', 'hard', 'barrel', 'xw'], 365.0, 'pb')}
SELECT batter, d, round(n_d, 6) AS n_d, round(hard_d / greatest(n_d, 1e-9), 6) AS hard_rate,
  round(barrel_d / greatest(n_d, 1e-9), 6) AS barrel_rate, round(xw_d / greatest(n_d, 1e-9), 4) AS xw_mean FROM pb""")
def contact_quality_panel(spark, d):
    pa = appearances(spark, d)
    daily = pa.groupBy("batter", "d").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") >= 50000).alias("hard"),
        F.count_if((F.col("price") >= 80000) & (F.col("disc") <= 0.05)).alias("barrel"), F.sum("price").alias("xw"))
    p = decayed_panel(daily, ["batter"], ["n", "hard", "barrel", "xw"], 365.0)
    return p.select("batter", "d", F.round("n_d", 6).alias("n_d"), F.round(ratio_floor("hard_d", "n_d"), 6).alias("hard_rate"),
                    F.round(ratio_floor("barrel_d", "n_d"), 6).alias("barrel_rate"),
                    F.round(ratio_floor("xw_d", "n_d"), 4).alias("xw_mean"))


@query("J3 Q5", f"""
WITH {EV}, {DAILY}, {panel_sql('daily', 'user_id', ['n'], HL)}
SELECT e.event_id, p.d AS pdate, round(p.n_d * power(2.0, -date_diff('day', p.d, e.d) / {HL}e0), 6) AS n_d
FROM ev e ASOF LEFT JOIN panel p ON e.user_id = p.user_id AND e.d > p.d""")
def asof_range_strategy(spark, d):
    """The same join answered with validity intervals."""
    panel = decayed_panel(_daily(spark, d), ["user_id"], ["n"], HL)
    j = asof_join(events(spark, d), panel, ["user_id"], ["n_d"], half_life=HL, match_date="pdate", strategy="range")
    return j.select("event_id", "pdate", F.round("n_d", 6).alias("n_d"))


STINT = "CASE event_type WHEN 'signup' THEN 'place' WHEN 'error' THEN 'transfer' WHEN 'purchase' THEN 'activate' WHEN 'view' THEN 'rehab' END"


@query("J4", f"""
WITH {EV}, act AS (SELECT user_id, d, count(*) AS n_act FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, a.d AS act_date, a.n_act, CAST(coalesce(date_diff('day', a.d, e.d) <= 3, FALSE) AS INT) AS returned_3
FROM ev e ASOF LEFT JOIN act a ON e.user_id = a.user_id AND e.d >= a.d""")
def asof_inclusive_return(spark, d):
    """Latest activation on or before the day; same-day activations count."""
    ev = events(spark, d)
    act = ev.filter("event_type = 'purchase'").groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n_act"))
    j = asof_join(ev, act, ["user_id"], ["n_act"], strict=False, match_date="act_date")
    soon = F.coalesce(F.datediff("d", "act_date") <= 3, F.lit(False)).cast("int")
    return j.select("event_id", "act_date", "n_act", soon.alias("returned_3"))


@query("J5", f"""
WITH {EV}, pl AS (SELECT DISTINCT user_id, d FROM ev WHERE event_type = 'signup')
SELECT e.event_id, CASE WHEN date_diff('day', e.d, p.d) <= 3 THEN p.d END AS placed,
  CAST(coalesce(date_diff('day', e.d, p.d) <= 3, FALSE) AS INT) AS injury
FROM ev e ASOF LEFT JOIN pl p ON e.user_id = p.user_id AND e.d <= p.d""")
def asof_forward_tolerance(spark, d):
    """First placement on or after the day, kept only within three days."""
    ev = events(spark, d)
    pl = ev.filter("event_type = 'signup'").select("user_id", "d").distinct().withColumn("hit", F.lit(1))
    j = asof_join(ev, pl, ["user_id"], ["hit"], strict=False, direction="forward", tolerance_days=3, match_date="placed")
    return j.select("event_id", "placed", F.coalesce("hit", F.lit(0)).alias("injury"))


@query("J6", f"""
WITH {EV}, cum AS (SELECT user_id, d, sum(sum(value)) OVER (PARTITION BY user_id ORDER BY d) AS cv, sum(count(*)) OVER (PARTITION BY user_id ORDER BY d) AS cn
  FROM ev GROUP BY 1, 2)
SELECT e.event_id, CAST(coalesce(a.cn, 0) - coalesce(b.cn, 0) AS BIGINT) AS n_7, CAST(coalesce(a.cn, 0) - coalesce(c.cn, 0) AS BIGINT) AS n_14,
  round(coalesce(a.cv, 0) - coalesce(b.cv, 0), 4) AS v_7
FROM ev e ASOF LEFT JOIN cum a ON e.user_id = a.user_id AND e.d > a.d
ASOF LEFT JOIN cum b ON e.user_id = b.user_id AND e.d - INTERVAL 7 DAY > b.d
ASOF LEFT JOIN cum c ON e.user_id = c.user_id AND e.d - INTERVAL 14 DAY > c.d""")
def asof_offsets_difference(spark, d):
    """Cumulative values at D, D-7 and D-14 (same day excluded); their differences are window sums."""
    from pyspark.sql import Window

    ev = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    cum = ev.groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(
        "user_id", "d", F.sum("n").over(w).alias("cn"), F.sum("v").over(w).alias("cv"))
    j = ev
    for off in (0, 7, 14):
        j = asof_join(j, cum.select("user_id", "d", F.col("cn").alias(f"cn{off}"), F.col("cv").alias(f"cv{off}")),
                      ["user_id"], [f"cn{off}", f"cv{off}"], offset_days=off)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("event_id", (z("cn0") - z("cn7")).alias("n_7"), (z("cn0") - z("cn14")).alias("n_14"),
                    F.round(z("cv0") - z("cv7"), 4).alias("v_7"))


@query("S11 S17", f"""
WITH {EV}, snap AS (SELECT user_id, ts AS snap_ts, value AS snap_value FROM ev WHERE event_type = 'view')
SELECT e.event_id, s.snap_ts AS match_ts, s.snap_value FROM ev e ASOF LEFT JOIN snap s ON e.user_id = s.user_id AND e.ts >= s.snap_ts""")
def newest_snapshot_at_serve(spark, d):
    """Newest snapshot at or before each serve time, at timestamp grain."""
    ev = events(spark, d)
    snap = ev.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("snap_value"))
    return asof_time_join(ev.select("event_id", "user_id", "ts"), snap, ["user_id"], ["snap_value"], strict=False).select(
        "event_id", "match_ts", "snap_value")


@query("W1 J3 P9", f"""
WITH {EV}, {DAILY},
{panel_sql('daily', 'user_id', ['n'] + EVENT_CLASSES, 30.0, 'slow')}, {panel_sql('daily', 'user_id', ['n'] + EVENT_CLASSES, 3.0, 'fast')},
j AS (SELECT e.event_id, s.n_d * power(2.0, -date_diff('day', s.d, e.d) / 30.0) AS sn, s.error_d * power(2.0, -date_diff('day', s.d, e.d) / 30.0) AS se,
  s.view_d * power(2.0, -date_diff('day', s.d, e.d) / 30.0) AS sv,
  f.n_d * power(2.0, -date_diff('day', f.d, e.d) / 3.0) AS fn, f.error_d * power(2.0, -date_diff('day', f.d, e.d) / 3.0) AS fe
  FROM ev e ASOF LEFT JOIN slow s ON e.user_id = s.user_id AND e.d > s.d ASOF LEFT JOIN fast f ON e.user_id = f.user_id AND e.d > f.d)
SELECT event_id, round(se / greatest(sn, 1e-9), 9) AS error_slow, round(fe / greatest(fn, 1e-9), 9) AS error_fast,
  0.0 + round(fe / greatest(fn, 1e-9) - se / greatest(sn, 1e-9), 9) AS error_trend,
  CASE WHEN sn >= 5 THEN round(sv / sn, 9) END AS view_gated, round((se / greatest(sn, 1e-9)) * (sv / greatest(sn, 1e-9)), 9) AS mx_error_view,
  round(ln(1 + coalesce(sn, 0)), 9) AS log_n FROM j""")
def assembled_features(spark, d):
    """Several panels of one entity joined as of each row in a single window pass, then ratios and products."""
    ev, daily = events(spark, d), _daily(spark, d)
    stats = ["n", *EVENT_CLASSES]
    panels = {name: (decayed_panel(daily, ["user_id"], stats, hl), [s + "_d" for s in stats], hl)
              for name, hl in (("slow", 30.0), ("fast", 3.0))}
    j = multi_panel_asof(ev, ["user_id"], panels)
    es, ef, vs = (ratio_floor(a, b) for a, b in (("slow_error_d", "slow_n_d"), ("fast_error_d", "fast_n_d"), ("slow_view_d", "slow_n_d")))
    return j.select(
        "event_id", F.round(es, 9).alias("error_slow"), F.round(ef, 9).alias("error_fast"), F.round(ef - es, 9).alias("error_trend"),
        F.when(F.col("slow_n_d") >= 5, F.round(F.col("slow_view_d") / F.col("slow_n_d"), 9)).alias("view_gated"),
        F.round(es * vs, 9).alias("mx_error_view"), F.round(F.log1p(F.coalesce("slow_n_d", F.lit(0.0))), 9).alias("log_n"))


@query("Q5", f"""
WITH {EV}, {DAILY} SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE p.d IS NULL) AS BIGINT) AS n_no_history, CAST(count(*) FILTER (WHERE p.d >= e.d) AS BIGINT) AS n_leaks
FROM ev e ASOF LEFT JOIN daily p ON e.user_id = p.user_id AND e.d > p.d""")
def leakage_audit(spark, d):
    panel = decayed_panel(_daily(spark, d), ["user_id"], ["n"], HL)
    j = asof_join(events(spark, d), panel, ["user_id"], ["n_d"], match_date="pdate")
    return audit_leakage(j, "d", "pdate")


PASEAS = f"sea AS (SELECT pitcher, season, count(*) AS n, {', '.join(f'''CAST(count(*) FILTER (WHERE label = '{c}') AS BIGINT) AS {c}''' for c in LABELS)} FROM pa GROUP BY 1, 2)"


def _season_counts(spark, d, keys=("pitcher", "season")):
    return S.class_counts(appearances(spark, d), list(keys), "label", LABELS)


@query("J2 P8", f"""
WITH {PA}, {PASEAS}, r AS (SELECT pitcher, season, cR * 1.0 / n AS r_rate FROM sea WHERE n >= 20)
SELECT s.pitcher, s.season, s.n, round(coalesce(r.r_rate, 0.33), 6) AS prior_rate FROM sea s LEFT JOIN r ON s.pitcher = r.pitcher AND s.season = r.season + 1""")
def prior_season_join(spark, d):
    sea = _season_counts(spark, d)
    dim = sea.filter("n >= 20").select("pitcher", "season", (F.col("cR") / F.col("n")).alias("prior_rate"))
    j = S.prior_season(sea, dim, ["pitcher"], "season", "season", ["prior_rate"], {"prior_rate": 0.33})
    return j.select("pitcher", "season", "n", F.round("prior_rate", 6).alias("prior_rate"))


@query("A6 A50", f"""
WITH {PA}, c AS (SELECT season, status, label, count(*) AS n FROM pa GROUP BY 1, 2, 3)
SELECT season, status, label, n, round(n * 1.0 / sum(n) OVER (PARTITION BY season, status), 6) AS rate FROM c""")
def league_shares(spark, d):
    return S.category_shares(appearances(spark, d), ["season", "status"], "label").select(
        "season", "status", "label", "n", F.round("rate", 6).alias("rate"))


@query("A7 P8 X27", f"""
WITH {PA}, {PASEAS}, big AS (SELECT * FROM sea WHERE n >= 30), l AS (
{' UNION ALL '.join(f"SELECT '{c}' AS cls, n, {c} * 1.0 / n AS p FROM big" for c in LABELS)}),
s AS (SELECT cls, count(*) AS n_units, avg(p) AS m, var_samp(p) AS v, avg(1.0 / n) AS inv FROM l GROUP BY 1)
SELECT cls, n_units, round(least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6), 20), 2000), 4) AS k FROM s""")
def mom_sample_size(spark, d):
    sea = _season_counts(spark, d).filter("n >= 30")
    rates = sea.select("n", *[(F.col(c) / F.col("n")).alias(c) for c in LABELS])
    return S.mom_sample_size(rates, "n", LABELS).select("cls", "n_units", F.round("k", 4).alias("k"))


def _factor_sql(window: str, k: float) -> str:
    facs = ", ".join(f"round(1.0 + o.n / (o.n + {k}) * ((o.{c} * 1.0 / greatest(o.n, 1)) / greatest(l.{c}, 1e-9) - 1.0), 6) AS f_{c}" for c in LABELS)
    return f"""yrs AS (SELECT unnest(generate_series(1996, (SELECT max(season) + 1 FROM sea))) AS year),
lgs AS (SELECT season, {', '.join(f'sum({c}) * 1.0 / sum(n) AS {c}' for c in LABELS)} FROM sea GROUP BY 1),
lg AS (SELECT year, {', '.join(f'avg({c}) AS {c}' for c in LABELS)} FROM yrs JOIN lgs ON {window} GROUP BY 1),
own AS (SELECT g, year, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in LABELS)} FROM yrs JOIN sea ON {window} GROUP BY 1, 2)
SELECT o.g, CAST(o.year AS INT) AS year, {facs} FROM own o JOIN lg l USING (year)"""


VEN = f"""sea AS (SELECT s_nationkey AS g, season, count(*) AS n, {', '.join(f'''count(*) FILTER (WHERE label = '{c}') AS {c}''' for c in LABELS)}
FROM pa JOIN supplier ON pitcher = s_suppkey GROUP BY 1, 2)"""


def _venue_counts(spark, d):
    from asofkit.plans._roles import table

    sup = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"))
    pa = appearances(spark, d).join(sup, F.col("pitcher") == F.col("s_suppkey"))
    return S.class_counts(pa, ["g", "season"], "label", LABELS)


@query("A8 U2", f"WITH {PA}, {VEN}, {_factor_sql('season >= year - 3 AND season < year', 2000.0)}")
def rolling_prior_factors(spark, d):
    """Venue multipliers over the three seasons before, shrunk to 1."""
    f = S.prior_factors(_venue_counts(spark, d), ["g"], [], "season", LABELS, "n", 2000.0, seasons_back=3)
    return f.select("g", "year", *[F.round(f"f_{c}", 6).alias(f"f_{c}") for c in LABELS])


@query("A9 J18", f"""WITH {PA}, {VEN}, {_factor_sql('season < year', 1500.0).replace('SELECT o.g, CAST', 'SELECT o.g, o.n AS rows_before, CAST')}""")
def cumulative_prior_factors(spark, d):
    """Factors from all earlier seasons, full-outer merged with the exposure behind them."""
    counts = _venue_counts(spark, d)
    f = S.prior_factors(counts, ["g"], [], "season", LABELS, "n", 1500.0)
    last = counts.agg(F.max("season") + 1).scalar()
    seen = counts.withColumn("hi", last).select(
        "g", F.explode(F.sequence(F.col("season") + 1, F.col("hi"))).alias("year"), "n").groupBy("g", "year").agg(
        F.sum("n").alias("rows_before"))
    return f.join(seen, ["g", "year"], "full_outer").select(
        "g", F.col("rows_before").cast("decimal(38,0)").cast("long").alias("rows_before"), "year",
        *[F.round(f"f_{c}", 6).alias(f"f_{c}") for c in LABELS])


@query("A17", f"""
WITH {PA}, {PASEAS}, lg AS (SELECT sum(cR) * 1.0 / sum(n) AS lg FROM sea),
c AS (SELECT pitcher, season, coalesce(sum(n) OVER w, 0) AS n_prior, coalesce(sum(cR) OVER w, 0) AS r_prior FROM sea
  WINDOW w AS (PARTITION BY pitcher ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (r_prior + 150.0 * lg) / (n_prior + 150.0) AS rate FROM c, lg),
s AS (SELECT stddev_samp(rate) AS sd FROM r WHERE n_prior >= 50)
SELECT pitcher, season, CAST(n_prior AS BIGINT) AS n_prior, round(rate, 6) AS rate, round(least(greatest((rate - lg) / greatest(sd, 1e-6), -2.5), 2.5), 6) AS z FROM r, s""")
def cumulative_prior_eb_rate(spark, d):
    r = S.cumulative_eb_rate(_season_counts(spark, d), ["pitcher"], "season", "cR", "n", 150.0, 50)
    return r.select("pitcher", "season", "n_prior", F.round("rate", 6).alias("rate"), F.round("z", 6).alias("z"))


@query("A16", f"""
WITH {PA}, q AS (SELECT pitcher, season, avg(price) AS v FROM pa GROUP BY 1, 2)
SELECT pitcher, season, round(coalesce(least(greatest((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), -2.5), 2.5), 0), 6) AS z
FROM q WINDOW w AS (PARTITION BY season)""")
def season_zscore(spark, d):
    q = appearances(spark, d).groupBy("pitcher", "season").agg(F.avg("price").alias("v"))
    return S.season_zscore(q, "v", ["season"]).select("pitcher", "season", F.round("z", 6).alias("z"))


@query("W3", f"""
WITH {PA}, q AS (SELECT batter, season, avg(qty) AS v FROM pa GROUP BY 1, 2)
SELECT batter, season, round(CASE WHEN season - lag(season) OVER w = 1 THEN v - lag(v) OVER w END, 6) AS v_chg
FROM q WINDOW w AS (PARTITION BY batter ORDER BY season)""")
def year_over_year_change(spark, d):
    """Seasons with a gap (entities without rows in a season) give no change."""
    q = appearances(spark, d).groupBy("batter", "season").agg(F.avg("qty").alias("v"))
    return S.year_over_year(q, ["batter"], "season", ["v"]).select("batter", "season", F.round("v_chg", 6).alias("v_chg"))


@query("W5", f"""
WITH {GAMES}, st AS (SELECT home AS team, season, d, home_score * 1.0 AS v FROM games WHERE home_score IS NOT NULL),
lg AS (SELECT season + 1 AS season, avg(v) AS lg_prev FROM st GROUP BY 1), cl AS (SELECT team, season + 1 AS season, sum(v) AS ps, count(v) AS pn FROM st GROUP BY 1, 2),
dd AS (SELECT DISTINCT team, season, d FROM st),
run AS (SELECT a.team, a.season, a.d, coalesce(sum(b.v), 0) AS cs, count(b.v) AS cn FROM dd a LEFT JOIN st b ON a.team = b.team AND a.season = b.season AND b.d < a.d GROUP BY 1, 2, 3)
SELECT run.team, run.season, run.d, round(lg_prev, 6) AS lg_prev,
 round((cs + 25.0 * ((coalesce(ps, 0) + 40.0 * lg_prev) / (coalesce(pn, 0) + 40.0))) / (cn + 25.0) - lg_prev, 6) AS lean
FROM run LEFT JOIN lg ON run.season = lg.season LEFT JOIN cl ON run.team = cl.team AND run.season = cl.season""")
def season_to_date_two_level(spark, d):
    st = games(spark, d).filter("home_score IS NOT NULL").select(F.col("home").alias("team"), "season", "d",
                                                                  F.col("home_score").cast("double").alias("v"))
    r = S.two_level_mean(st, "team", "season", "d", "v", 25.0, 40.0)
    return r.select("team", "season", "d", F.round("lg_prev", 6).alias("lg_prev"), F.round("lean", 6).alias("lean"))


@query("A12 J11 L4", f"""
WITH {PA}, lo AS (SELECT batter, season AS year, status AS level, count(*) AS n, CAST(count(*) FILTER (WHERE label = 'cR') AS BIGINT) AS cR, CAST(count(*) FILTER (WHERE label = 'cA') AS BIGINT) AS cA
  FROM pa WHERE pitcher % 2 = 0 GROUP BY 1, 2, 3),
hi AS (SELECT batter, season AS year, count(*) AS n, count(*) FILTER (WHERE label = 'cR') AS cR, count(*) FILTER (WHERE label = 'cA') AS cA FROM pa WHERE pitcher % 2 = 1 GROUP BY 1, 2),
pairs AS (SELECT lo.level, lo.n AS ln, lo.cR AS lR, lo.cA AS lA, hi.n AS hn, hi.cR AS hR, hi.cA AS hA FROM lo JOIN hi ON lo.batter = hi.batter AND hi.year = lo.year + 1),
f AS (SELECT level, least(greatest((sum(hR) / greatest(sum(hn), 1)) / greatest(sum(lR) / greatest(sum(ln), 1), 1e-6), 0.1), 3.0) AS f_R,
  least(greatest((sum(hA) / greatest(sum(hn), 1)) / greatest(sum(lA) / greatest(sum(ln), 1), 1e-6), 0.1), 3.0) AS f_A FROM pairs GROUP BY 1),
entry AS (SELECT DISTINCT batter, year + 1 AS entry FROM lo),
past AS (SELECT e.batter, e.entry, lo.*, row_number() OVER (PARTITION BY e.batter, e.entry ORDER BY lo.year DESC, lo.level DESC) AS rn
  FROM entry e JOIN lo ON e.batter = lo.batter AND lo.year < e.entry)
SELECT past.batter, past.entry, round(sum(cR * f_R) / sum(n), 6) AS prior_cR, round(sum(cA * f_A) / sum(n), 6) AS prior_cA, CAST(sum(n) AS BIGINT) AS prior_n
FROM past JOIN f USING (level) WHERE rn <= 2 GROUP BY 1, 2""")
def level_translated_priors(spark, d):
    """Lower levels are the even suppliers (two statuses), the upper level the odd ones."""
    pa = appearances(spark, d)
    lo = S.class_counts(pa.filter("pitcher % 2 = 0"), ["batter", "season", "status"], "label", ["cR", "cA"])
    hi = S.class_counts(pa.filter("pitcher % 2 = 1"), ["batter", "season"], "label", ["cR", "cA"])
    f = S.level_translation(lo, hi, "batter", "season", "status", "n", ["cR", "cA"])
    r = S.translated_priors(lo, f, "batter", "season", "status", "n", ["cR", "cA"])
    return r.select("batter", "entry", F.round("prior_cR", 6).alias("prior_cR"), F.round("prior_cA", 6).alias("prior_cA"), "prior_n")


TH = ["v2", "v3", "v4"]


@query("A25 A50", f"""
WITH {EV}, daily AS (SELECT user_id, d, count(*) AS g, count(*) FILTER (WHERE value >= 20) AS v2, count(*) FILTER (WHERE value >= 50) AS v3, count(*) FILTER (WHERE value >= 100) AS v4 FROM ev GROUP BY 1, 2),
lg AS (SELECT sum(v2) / sum(g) AS l2, sum(v3) / sum(g) AS l3, sum(v4) / sum(g) AS l4 FROM daily),
{panel_sql('daily', 'user_id', ['g', *TH], 7.0, 'pd')}, {panel_sql('daily', 'user_id', ['g', *TH], 36500.0, 'pc')}
SELECT e.event_id,
 {', '.join(f"round((coalesce(pd.v{i}_d * power(2.0, -date_diff('day', pd.d, e.d) / 7.0), 0) + 40.0 * l{i}) / (coalesce(pd.g_d * power(2.0, -date_diff('day', pd.d, e.d) / 7.0), 0) + 40.0), 6) AS th_v{i}" for i in (2, 3, 4))},
 {', '.join(f"round((coalesce(pc.v{i}_d * power(2.0, -date_diff('day', pc.d, e.d) / 36500.0), 0) + 40.0 * l{i}) / (coalesce(pc.g_d * power(2.0, -date_diff('day', pc.d, e.d) / 36500.0), 0) + 40.0), 6) AS thc_v{i}" for i in (2, 3, 4))},
 round(ln(1 + coalesce(pd.g_d * power(2.0, -date_diff('day', pd.d, e.d) / 7.0), 0)), 6) AS log_n
FROM ev e ASOF LEFT JOIN pd ON e.user_id = pd.user_id AND e.d > pd.d ASOF LEFT JOIN pc ON e.user_id = pc.user_id AND e.d > pc.d CROSS JOIN lg""")
def threshold_shares(spark, d):
    ev = events(spark, d)
    daily = ev.groupBy("user_id", "d").agg(
        F.count(F.lit(1)).alias("g"), F.count_if(F.col("value") >= 20).alias("v2"),
        F.count_if(F.col("value") >= 50).alias("v3"), F.count_if(F.col("value") >= 100).alias("v4"))
    lg = {s: daily.agg(F.sum(s) / F.sum("g")).scalar() for s in TH}
    hz = {"th": (decayed_panel(daily, ["user_id"], ["g", *TH], 7.0), 7.0),
          "thc": (decayed_panel(daily, ["user_id"], ["g", *TH], 36500.0), 36500.0)}
    r = S.threshold_shares(ev, hz, ["user_id"], TH, "g", lg, 40.0)
    return r.select("event_id", *[F.round(f"{h}_{s}", 6).alias(f"{h}_{s}") for h in hz for s in TH], F.round("log_n", 6).alias("log_n"))


@query("J7 A11", f"""
WITH {PA}, pt AS (SELECT p_partkey, p_type FROM part), u0 AS (SELECT pitcher, season, p_type, count(*) AS n FROM pa JOIN pt ON batter = p_partkey GROUP BY 1, 2, 3),
u AS (SELECT pitcher, season, p_type, n * 1.0 / sum(n) OVER (PARTITION BY pitcher, season) AS usage FROM u0),
v AS (SELECT c_nationkey AS nation, p_type, avg(price) AS val FROM pa JOIN orders ON game = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN pt ON batter = p_partkey GROUP BY 1, 2),
r AS (SELECT DISTINCT pitcher, season, c_nationkey AS nation FROM pa JOIN orders ON game = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT r.pitcher, r.season, r.nation, round(sum(u.usage * v.val), 4) AS edge, count(*) AS n_types
FROM r JOIN u ON r.pitcher = u.pitcher AND r.season = u.season JOIN v ON v.nation = r.nation AND v.p_type = u.p_type GROUP BY 1, 2, 3""")
def matchup_dot_product(spark, d):
    """Usage mix of one side times the other side's value per type. The mix is held as a map per
    entity-season (its size is the number of types), so a pair needs no row fan-out."""
    from asofkit.operators.joins import dot_product
    from asofkit.plans._roles import table

    pa = appearances(spark, d)
    part = table(spark, d, "part").select("p_partkey", "p_type")
    cust = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("game"), F.col("c_nationkey").alias("nation"))
    typed = pa.join(part, F.col("batter") == F.col("p_partkey"))
    usage = S.category_shares(typed, ["pitcher", "season"], "p_type", "usage")
    value = typed.join(cust, "game").groupBy("nation", "p_type").agg(F.avg("price").alias("val"))
    rows = pa.join(cust, "game").select("pitcher", "season", "nation").distinct()
    r = dot_product(rows, usage, value, ["pitcher", "season"], ["nation"], "p_type", "usage", "val", "edge", "n_types")
    return r.filter("n_types > 0").select("pitcher", "season", "nation", F.round("edge", 4).alias("edge"), F.col("n_types").cast("long").alias("n_types"))


@query("A11 J11", f"""
WITH {PA}, u0 AS (SELECT pitcher, season, p_type, count(*) AS n FROM pa JOIN part ON batter = p_partkey GROUP BY 1, 2, 3),
u AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY pitcher, season) AS s FROM u0),
e AS (SELECT pitcher, season, sum(-s * ln(s)) AS ent, coalesce(max(CASE WHEN p_type = 'ECONOMY' THEN s END), 0) AS eco FROM u GROUP BY 1, 2)
SELECT a.pitcher, a.season, round(a.ent, 6) AS entropy, round(a.eco, 6) AS share_economy, round(a.ent - b.ent, 6) AS entropy_trend
FROM e a LEFT JOIN e b ON a.pitcher = b.pitcher AND a.season = b.season + 1""")
def usage_entropy_trend(spark, d):
    from asofkit.plans._roles import table

    part = table(spark, d, "part").select("p_partkey", "p_type")
    u = S.category_shares(appearances(spark, d).join(part, F.col("batter") == F.col("p_partkey")), ["pitcher", "season"], "p_type", "s")
    e = u.groupBy("pitcher", "season").agg(F.sum(-F.col("s") * F.log("s")).alias("entropy"),
                                           F.coalesce(F.max(F.when(F.col("p_type") == "ECONOMY", F.col("s"))), F.lit(0.0)).alias("share_economy"))
    j = S.prior_season(e, e.withColumnRenamed("entropy", "prev"), ["pitcher"], "season", "season", ["prev"])
    return j.select("pitcher", "season", F.round("entropy", 6).alias("entropy"), F.round("share_economy", 6).alias("share_economy"),
                    F.round(F.col("entropy") - F.col("prev"), 6).alias("entropy_trend"))


