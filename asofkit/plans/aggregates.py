"""Aggregation queries on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.operators import aggs as A
from asofkit.operators import choice as C
from asofkit.operators.asof import asof_join
from asofkit.operators.scan import Index, group_totals, null_safe_join, ordered_scan
from asofkit.plans._roles import EV, GAMES, PA, PA_ORD, PA_ORDER, appearances, events, games, table
from asofkit.plans.evaluation import r6
from asofkit.registry import query
from asofkit.session import cut_lineage

# measure -> (value, condition) in Spark SQL, shared with the oracle text
MEASURES = {
    "all": ("price", "TRUE"), "hi": ("price", "price >= 60000"), "lo": ("price", "price < 20000"), "disc": ("disc", "disc > 0"),
    "fast": ("qty", "label = 'cA'"), "brk": ("qty", "label = 'cN'"), "off": ("qty", "label = 'cR'"), "first": ("price", "seq = 1"),
    "late": ("price", "seq >= 5"), "ahead": ("qty", "status = 'F' AND label <> 'cR'"), "behind": ("qty", "status = 'O'"), "edge": ("tax", "tax BETWEEN 0.03 AND 0.06"),
}
_SS = ", ".join(f"""count({v}) FILTER (WHERE {c}) AS {n}_n, round(coalesce(sum({v}) FILTER (WHERE {c}), 0), 4) AS {n}_v, round(coalesce(sum({v} * {v}) FILTER (WHERE {c}), 0), 4) AS {n}_vv""" for n, (v, c) in MEASURES.items())


@query("A2 X15", f"WITH {PA} SELECT pitcher, d, count(*) AS n, {_SS} FROM pa GROUP BY 1, 2")
def sufficient_statistics(spark, d):
    m = {n: (F.expr(v), F.expr(c)) for n, (v, c) in MEASURES.items()}
    r = A.sufficient_stats(appearances(spark, d), ["pitcher", "d"], m)
    return r.select("pitcher", "d", "n", *[x for n in MEASURES for x in (F.col(f"{n}_n"), F.round(f"{n}_v", 4).alias(f"{n}_v"), F.round(f"{n}_vv", 4).alias(f"{n}_vv"))])


@query("A3 L1 P3", f"""WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY {PA_ORD}) AS a, row_number() OVER (PARTITION BY game ORDER BY {', '.join(c + ' DESC' for c in PA_ORDER)}) AS z FROM pa)
SELECT game, max(label) FILTER (WHERE z = 1) AS label_last, max(status) FILTER (WHERE z = 1) AS status_last, max(qty) FILTER (WHERE a = 1) AS qty_first FROM r GROUP BY 1""")
def first_last_in_game(spark, d):
    r = A.first_last(appearances(spark, d), ["game"], PA_ORDER, ["qty"], ["label", "status"])
    return r.select("game", "label_last", "status_last", "qty_first")


@query("A4 W24", f"""WITH {PA}, i AS (SELECT *, row_number() OVER (PARTITION BY pitcher, season ORDER BY d, game, {PA_ORD}) - 1 AS i FROM pa)
SELECT pitcher, season, count(*) AS w, round(regr_slope(price, i) * count(*), 4) AS slope_w FROM i GROUP BY 1, 2 HAVING count(*) >= 8""")
def grouped_slope(spark, d):
    r = ordered_scan(appearances(spark, d), ["pitcher", "season"], ["d", "game", *PA_ORDER], F.col("d"), [Index("i1")]).withColumn("i", F.col("i1") - 1)
    return A.grouped_slope(r, ["pitcher", "season"], "i", "price", 8).select("pitcher", "season", "w", F.round("slope_w", 4).alias("slope_w"))


@query("A10", f"""WITH {PA}, t AS (SELECT s_nationkey AS team, season, CASE WHEN s_suppkey % 7 <> 0 THEN disc END AS v, qty AS w, label, price FROM pa JOIN supplier ON pitcher = s_suppkey)
SELECT team, season, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS wmean, round(27.0 * count(*) FILTER (WHERE label = 'cR') / nullif(sum(w), 0), 6) AS per27, round(162.0 * sum(price) / 1e6 / count(*), 6) AS per162 FROM t GROUP BY 1, 2""")
def rate_composites(spark, d):
    t = appearances(spark, d).join(table(spark, d, "supplier"), F.col("pitcher") == F.col("s_suppkey"))
    v = F.when(F.col("s_suppkey") % 7 != 0, F.col("disc"))
    r = t.groupBy(F.col("s_nationkey").alias("team"), "season").agg(A.weighted_skip(v, F.col("qty")).alias("wmean"),
        (27.0 * F.count_if(F.col("label") == "cR") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("per27"), (162.0 * F.sum("price") / 1e6 / F.count(F.lit(1))).alias("per162"))
    return r6(r, "team", "season")


MOVES = "mv AS (SELECT game, seq AS play, batter % 4 AS runner, d, batter, pitcher, price, CAST(batter % 4 AS INT) AS sb, CAST(1 + (pitcher + seq) % 4 AS INT) AS eb, (label = 'cR')::INT AS out, status FROM pa)"
_MO = "d, batter, pitcher, price"


def _moves(spark, d):
    return appearances(spark, d).select("game", F.col("seq").alias("play"), (F.col("batter") % 4).alias("runner"), "d", "batter", "pitcher", "price",
                                        (F.col("batter") % 4).cast("int").alias("sb"), (1 + (F.col("pitcher") + F.col("seq")) % 4).cast("int").alias("eb"),
                                        (F.col("label") == "cR").cast("int").alias("out"), "status")


@query("A13", f"""WITH {PA}, {MOVES}, r AS (SELECT game, play, runner, arg_min(sb, ({_MO})) AS s, arg_max(eb, ({_MO})) AS e, max(out) AS o FROM mv GROUP BY 1, 2, 3),
dd AS (SELECT *, CASE WHEN o = 1 THEN 0 WHEN e = s THEN 9 ELSE e END AS dest FROM r),
w AS (SELECT game, play, coalesce(max(dest) FILTER (WHERE s = 0), 9) AS s0, coalesce(max(dest) FILTER (WHERE s = 1), 9) AS s1, coalesce(max(dest) FILTER (WHERE s = 2), 9) AS s2, coalesce(max(dest) FILTER (WHERE s = 3), 9) AS s3, sum(o) AS outs, count(*) FILTER (WHERE dest = 4) AS runs FROM dd GROUP BY 1, 2),
c AS (SELECT play % 3 AS k, s0, s1, s2, s3, CAST(outs AS BIGINT) AS outs, CAST(runs AS BIGINT) AS runs, count(*) AS n FROM w GROUP BY ALL)
SELECT CAST(k AS INT) AS k, s0, s1, s2, s3, outs, runs, n, round(n * 1.0 / sum(n) OVER (PARTITION BY k), 6) AS p FROM c""")
def movement_patterns(spark, d):
    w = A.movement_patterns(_moves(spark, d), ["game", "play"], "runner", ["d", "batter", "pitcher", "price"], "sb", "eb", "out", [0, 1, 2, 3])
    r = A.pattern_distribution(w.withColumn("k", F.col("play") % 3), ["k"], ["s0", "s1", "s2", "s3", "outs", "runs"])
    return r.withColumn("p", F.round("p", 6))


@query("A14", f"""WITH {PA} SELECT 'return' AS event, (SELECT count(*) FROM (SELECT DISTINCT game, seq FROM pa WHERE label = 'cR')) AS n_events, round((SELECT count(*) FROM (SELECT DISTINCT game, seq FROM pa WHERE label = 'cR')) * 1.0 / (SELECT count(*) FROM pa WHERE status = 'O'), 6) AS rate""")
def pre_event_rate(spark, d):
    pa = appearances(spark, d)
    r = A.event_rate(pa.filter("label = 'cR'"), ["game", "seq"], pa.filter("status = 'O'"), "return")
    return r6(r, "event", "n_events")


@query("A15 J2", f"""WITH {PA}, opp AS (SELECT game, seq, season FROM pa WHERE status = 'O'), ev2 AS (SELECT game, seq, max((disc >= 0.05)::INT) AS success FROM pa WHERE label = 'cR' GROUP BY 1, 2),
er AS (SELECT game, min(season) AS season FROM pa GROUP BY 1), o AS (SELECT CASE WHEN opp.season < 1998 THEN 'early' ELSE 'late' END AS era, (ev2.game IS NOT NULL)::INT AS att, coalesce(success, 0) AS suc FROM opp LEFT JOIN ev2 USING (game, seq)),
t AS (SELECT CASE WHEN season < 1998 THEN 'early' ELSE 'late' END AS era, count(*) AS true_n, avg(success) AS st FROM ev2 JOIN er USING (game) GROUP BY 1)
SELECT era, count(*) AS n, CAST(sum(att) AS BIGINT) AS attempts, CAST(sum(suc) AS BIGINT) AS successes, round(any_value(true_n) * 1.0 / greatest(sum(att), 1), 6) AS attempt_scale, round(any_value(st), 6) AS success_true FROM o JOIN t USING (era) GROUP BY 1""")
def attempt_success_table(spark, d):
    """Opportunities with matched events; scale factors are all true events over the matched ones, by era."""
    pa = appearances(spark, d)
    ev = pa.filter("label = 'cR'").groupBy("game", "seq").agg(F.max((F.col("disc") >= 0.05).cast("int")).alias("success"))
    era = F.when(F.col("season") < 1998, "early").otherwise("late").alias("era")
    opp = pa.filter("status = 'O'").select("game", "seq", "season").join(ev.withColumn("hit", F.lit(1)), ["game", "seq"], "left")
    o = opp.groupBy(era).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("attempts"), F.sum(F.coalesce("success", F.lit(0))).alias("successes"))
    season = pa.groupBy("game").agg(F.min("season").alias("season"))
    t = ev.join(season, "game").groupBy(era).agg(F.count(F.lit(1)).alias("true_n"), F.avg("success").alias("success_true"))
    return o.join(t, "era").select("era", "n", "attempts", "successes", F.round(F.col("true_n") / F.greatest("attempts", F.lit(1)), 6).alias("attempt_scale"), F.round("success_true", 6).alias("success_true"))


@query("A18", f"""WITH {PA}, a AS (SELECT avg((label = 'cA')::INT) AS aa, avg((label = 'cA')::INT) FILTER (WHERE status = 'O') AS an, avg((label = 'cA')::INT) FILTER (WHERE status <> 'O') AS af, avg((status = 'O')::INT) AS w FROM pa),
e AS (SELECT pitcher, count(*) FILTER (WHERE status = 'O') AS n1, count(*) FILTER (WHERE status <> 'O') AS n0, count(*) FILTER (WHERE status = 'O' AND label = 'cA') AS k1, count(*) FILTER (WHERE status <> 'O' AND label = 'cA') AS k0, avg(disc) AS z FROM pa GROUP BY 1),
s AS (SELECT z, (ln(greatest(least(k1*1.0/n1, 0.999), 0.001)) - ln(1 - greatest(least(k1*1.0/n1, 0.999), 0.001))) - (ln(greatest(least(k0*1.0/n0, 0.999), 0.001)) - ln(1 - greatest(least(k0*1.0/n0, 0.999), 0.001))) AS dl FROM e WHERE n1 >= 40 AND n0 >= 40)
SELECT round(any_value(w), 6) AS w_on, round(ln(any_value(an) / any_value(aa)), 6) AS da_on, round(ln(any_value(af) / any_value(aa)), 6) AS da_off, round(covar_pop(z, dl) / greatest(var_pop(z), 1e-9), 4) AS b1, count(*) AS n_entities FROM s, a""")
def conditional_offsets(spark, d):
    pa = appearances(spark, d)
    on, hit = F.col("status") == "O", F.col("label") == "cA"
    off = A.conditional_offsets(pa, on, {"a": hit})
    sp = A.logit_split(pa, "pitcher", on, hit, 40).join(pa.groupBy("pitcher").agg(F.avg("disc").alias("z")), "pitcher")
    b = sp.agg((F.covar_pop("z", "dlogit") / F.greatest(F.var_pop("z"), F.lit(1e-9))).alias("b1"), F.count(F.lit(1)).alias("n"))
    return off.select(F.round("w_on", 6).alias("w_on"), F.round("da_on", 6).alias("da_on"), F.round("da_off", 6).alias("da_off"),
                      F.round(b.select("b1").scalar(), 4).alias("b1"), b.select("n").scalar().alias("n_entities"))


@query("A20", f"""WITH {PA}, x AS (SELECT n_regionkey AS team, pitcher, d, game, seq, CAST(qty AS INT) AS np, (label = 'cA')::INT AS sv, (label = 'cR')::INT AS hld, CAST(qty AS INT) % 4 AS o,
 CAST(qty AS INT) % 9 >= 6 AND abs(CAST(round(disc * 100) AS INT) - 5) <= 2 AS hi FROM pa JOIN supplier ON pitcher = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT team, pitcher, d, count(*) AS n, sum(np) AS np, sum(sv) AS sv, sum(hld) AS hld, sum(o) AS o, min((seq, game, hi)) AS f FROM x GROUP BY 1, 2, 3),
ch AS (SELECT team, d, pitcher AS chosen, CASE WHEN f[3] THEN 'hi' ELSE 'lo' END AS ctx FROM (SELECT *, row_number() OVER (PARTITION BY team, d ORDER BY f, pitcher) AS rn FROM u) WHERE rn = 2 AND d >= (SELECT max(d) FROM x) - 730),
c AS (SELECT ch.team, ch.d, u.pitcher, any_value(chosen) AS chosen, any_value(ctx) AS ctx, coalesce(sum(n) FILTER (WHERE u.d >= ch.d - 30), 0) AS n30, coalesce(sum(n) FILTER (WHERE u.d = ch.d - 1), 0) AS n1, coalesce(sum(n) FILTER (WHERE u.d = ch.d - 2), 0) AS n2,
 coalesce(sum(np) FILTER (WHERE u.d = ch.d - 1), 0) AS np1, coalesce(sum(np) FILTER (WHERE u.d = ch.d - 2), 0) AS np2, sum(sv) AS sv, sum(hld) AS hld, sum(o) * 1.0 / sum(n) AS o FROM ch JOIN u ON ch.team = u.team AND u.d < ch.d AND u.d >= ch.d - 365 GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN np1 >= 20 OR (np1 > 0 AND np2 > 0) THEN 2 WHEN np1 >= 10 THEN 1 ELSE 0 END AS tier, row_number() OVER (PARTITION BY team, d ORDER BY n30 DESC, pitcher) AS ru FROM c WHERE n30 > 0 AND NOT (n1 > 0 AND n2 > 0) AND np1 < 25),
r AS (SELECT *, row_number() OVER (PARTITION BY team, d ORDER BY tier, CASE WHEN ctx = 'hi' THEN -(2.0 * sv + hld) ELSE -(o - 0.5 * (sv + hld)) END, ru) AS rank FROM e WHERE ru <= 8), n AS (SELECT ctx, rank, count(*) AS n FROM r WHERE pitcher = chosen GROUP BY 1, 2)
SELECT ctx, CAST(rank AS INT) AS rank, n, round(n * 1.0 / sum(n) OVER (PARTITION BY ctx), 6) AS p FROM n""")
def choice_rank_distribution(spark, d):
    """Rank of the day's second arm among the rested ones: by workload tier, then saves and holds when the
    entry is tight, by outs less half of saves and holds otherwise; choices of the last two years."""
    home = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("team")), "s_nationkey")
    pa = appearances(spark, d).join(home.select(F.col("s_suppkey").alias("pitcher"), "team"), "pitcher").withColumn("np", F.col("qty").cast("int"))
    tight = (F.col("np") % 9 >= 6) & (F.abs(F.round(F.col("disc") * 100).cast("int") - 5) <= 2)
    uses = pa.groupBy("team", "pitcher", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("np").alias("np"), F.count_if(F.col("label") == "cA").alias("sv"), F.count_if(F.col("label") == "cR").alias("hld"),
                                                  F.sum(F.col("np") % 4).alias("outs"), F.min(F.struct("seq", "game", tight.alias("hi"))).alias("first"))
    uses = cut_lineage(uses)
    recent = uses.filter(F.col("d") >= F.date_sub(uses.agg(F.max("d")).scalar(), 730))
    choices = C.nth_arm(recent, ["team"], "d", "pitcher", "first").select("team", "d", F.col("pitcher").alias("chosen"), F.when(F.col("first.hi"), "hi").otherwise("lo").alias("ctx"))
    pool = C.rested_pool(uses, choices, ["team"], "pitcher", "d", "n", "np", ["sv", "hld", "outs"]).filter(C.eligible())
    pool = pool.withColumn("hit", F.col("pitcher") == F.col("chosen")).withColumn("tier", C.workload_tier())
    closing = F.col("sv_history") + F.col("hld_history")
    rest = [-F.col("n_recent"), F.col("pitcher")]
    orders = {"hi": [F.col("tier"), -(F.col("sv_history") + closing), *rest], "lo": [F.col("tier"), -(F.col("outs_history") / F.col("n_history") - 0.5 * closing), *rest]}
    r = A.choice_rank_pmf(pool, ["team", "d"], orders, "ctx", "hit", [F.desc("n_recent"), F.asc("pitcher")], 8)
    return r.select("ctx", "rank", "n", F.round("p", 6).alias("p"))


CELLS = ["k", "slot", "inn", "lead"]
RISK = "risk AS (SELECT least(CAST(seq AS INT), 6) AS k, CAST(pitcher % 3 AS INT) AS slot, CASE WHEN price < 30000 THEN 0 WHEN price < 60000 THEN 1 ELSE 2 END AS inn, (disc > 0.05)::INT AS lead, (label = 'cR')::INT AS event, season FROM pa)"


def _risk(spark, d):
    p = F.col("price")
    return appearances(spark, d).select(
        F.least("seq", F.lit(6)).alias("k"), (F.col("pitcher") % 3).cast("int").alias("slot"), F.when(p < 30000, 0).when(p < 60000, 1).otherwise(2).alias("inn"),
        (F.col("disc") > 0.05).cast("int").alias("lead"), (F.col("label") == "cR").cast("int").alias("event"), "season")


@query("A21 A48", f"""WITH {PA}, {RISK}, m AS (SELECT k, slot, avg(event) AS m FROM risk GROUP BY 1, 2), g AS (SELECT k, slot, inn, lead, count(*) AS n, sum(event) AS ev FROM risk GROUP BY 1, 2, 3, 4),
rt AS (SELECT g.*, m, (ev + 300.0 * m) / (n + 300.0) AS rate FROM g JOIN m USING (k, slot)), cur AS (SELECT risk.event, rate FROM risk JOIN rt USING (k, slot, inn, lead) WHERE season = (SELECT max(season) FROM risk)),
an AS (SELECT count(*) / (count(*) + 30000.0) * (ln(avg(event) / (1 - avg(event))) - ln(avg(rate) / (1 - avg(rate)))) AS dl FROM cur),
grid AS (SELECT CAST(k AS INT) AS k, CAST(slot AS INT) AS slot, CAST(inn AS INT) AS inn, CAST(lead AS INT) AS lead FROM (SELECT unnest([1,2,3,4,5,6]) AS k), (SELECT unnest([0,1,2]) AS slot), (SELECT unnest([0,1,2,3]) AS inn), (SELECT unnest([0,1]) AS lead))
SELECT grid.k, grid.slot, grid.inn, grid.lead, coalesce(rt.n, 0) AS n, rt.rate IS NULL AS filled, round(1 / (1 + exp(-(ln(coalesce(rt.rate, m.m) / (1 - coalesce(rt.rate, m.m))) + dl))), 6) AS rate
FROM grid LEFT JOIN rt ON rt.k = grid.k AND rt.slot = grid.slot AND rt.inn = grid.inn AND rt.lead = grid.lead LEFT JOIN m ON m.k = grid.k AND m.slot = grid.slot CROSS JOIN an""")
def contingency_hazard(spark, d):
    """Shrunk cells, empty cells backfilled from their marginal, and one era shift over the grid."""
    risk = _risk(spark, d)
    rates = A.hazard_cells(risk, CELLS, ["k", "slot"], "event", 300.0)
    delta = A.era_anchor(risk, rates, CELLS, "event", "season")
    grid = A.backfill_cells(rates, {"k": range(1, 7), "slot": range(3), "inn": range(4), "lead": range(2)}, ["k", "slot"])
    return grid.select(*CELLS, "n", "filled", F.round(A.shift_rate(F.col("rate"), delta), 6).alias("rate"))


@query("A23", f"WITH {PA}, c AS (SELECT pitcher, season, label, count(*) AS n FROM pa GROUP BY 1, 2, 3) SELECT pitcher, season, label, n FROM (SELECT *, row_number() OVER (PARTITION BY pitcher, season ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1")
def modal_label(spark, d):
    return A.modal_value(appearances(spark, d), ["pitcher", "season"], "label").select("pitcher", "season", "label", "n")


@query("A26", f"""WITH {PA}, du AS (SELECT pitcher, game, count(*) AS dur, max(d) AS d FROM pa GROUP BY 1, 2), k AS (SELECT unnest(generate_series(0, 10)) AS k),
lg AS (SELECT k, count(*) FILTER (WHERE dur >= k) AS ar, count(*) FILTER (WHERE dur = k) AS ex FROM du, k GROUP BY 1), own AS (SELECT pitcher, k, count(*) FILTER (WHERE dur >= k) AS ar, count(*) FILTER (WHERE dur = k) AS ex FROM du, k WHERE d < DATE '2001-06-01' AND d >= DATE '2001-06-01' - 365 GROUP BY 1, 2)
SELECT pitcher, CAST(own.k AS INT) AS k, own.ar AS at_risk, round((own.ex + 12.0 * coalesce(lg.ex * 1.0 / nullif(lg.ar, 0), 0)) / (own.ar + 12.0), 6) AS exit FROM own JOIN lg ON own.k = lg.k""")
def exit_by_duration(spark, d):
    """Exit table of the trailing year, blended with twelve league stints."""
    du = appearances(spark, d).groupBy("pitcher", "game").agg(F.count(F.lit(1)).alias("dur"), F.max("d").alias("d"))
    lg = A.exit_table(du.withColumn("lg", F.lit(1)), ["lg"], "dur")
    own = A.exit_table(du.filter("d < DATE'2001-06-01' AND d >= date_sub(DATE'2001-06-01', 365)"), ["pitcher"], "dur")
    r = A.blended_exit(own, lg, ["pitcher"])
    return r.select("pitcher", "k", "at_risk", F.round("exit", 6).alias("exit"))


@query("A47", f"""WITH {EV} SELECT user_id, d, 'day' AS grain, NULL::BIGINT AS game, count(*) AS h, round(sum(value), 4) AS v FROM ev GROUP BY 1, 2 UNION ALL SELECT user_id, d, 'game', k % 2, count(*), round(sum(value), 4) FROM ev GROUP BY 1, 2, k % 2""")
def day_and_game_actuals(spark, d):
    ev = events(spark, d).withColumn("game", (F.col("k") % 2).cast("long"))
    g = ev.groupingSets([["user_id", "d"], ["user_id", "d", "game"]], "user_id", "d", "game").agg(F.count(F.lit(1)).alias("h"), F.round(F.sum("value"), 4).alias("v"), F.grouping("game").alias("g"))
    return g.select("user_id", "d", F.when(F.col("g") == 1, "day").otherwise("game").alias("grain"), "game", "h", "v")


@query("A49 ST2", f"""WITH {GAMES}, f AS (SELECT game, d FROM games WHERE home_score IS NOT NULL), c AS (SELECT l_orderkey AS game, count(*) AS n FROM lineitem GROUP BY 1)
SELECT f.d, f.game, coalesce(n, 0) AS n, coalesce(n, 0) < 2 AS stub FROM f LEFT JOIN c USING (game) WHERE f.d >= DATE '2001-05-01' AND f.d <= DATE '2001-05-31'""")
def count_completeness(spark, d):
    from asofkit.sources.repair import stub_counts

    f = games(spark, d).filter("home_score IS NOT NULL").select("game", "d")
    stored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"))
    return stub_counts(f, stored, "game", "d", "2001-05-31", 30, 2)


@query("A53 P7 X11", """SELECT o_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS h, CAST(sum(floor(l_quantity / 10) * 3 + round((l_quantity / 10 - floor(l_quantity / 10)) * 10)) AS BIGINT) AS outs, CAST(count(*) FILTER (WHERE l_returnflag = 'R') + 2 * count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS tb
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def graded_actuals(spark, d):
    from asofkit.functions.physics import ip_to_outs

    li = table(spark, d, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("h"), F.sum(ip_to_outs(F.col("l_quantity") / 10)).alias("outs"),
        (F.count_if(F.col("l_returnflag") == "R") + 2 * F.count_if(F.col("l_returnflag") == "A")).alias("tb"))
    return s.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("A54 X29", f"""WITH {EV}, b AS (SELECT user_id, d, list(DISTINCT k % 12) FILTER (WHERE event_type = 'view') AS bf, list(DISTINCT k % 12) AS af FROM ev WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2),
s AS (SELECT *, len(bf) AS nb, len(af) AS na FROM b), t AS (SELECT *, na <> coalesce(nb, 0) AS contributed FROM s)
SELECT d, count(*) AS sides, CAST(sum(contributed::INT) AS BIGINT) AS contributed, CAST(sum((contributed AND coalesce(nb, 0) = 0)::INT) AS BIGINT) AS fully, CAST(sum((contributed AND coalesce(nb, 0) > 0)::INT) AS BIGINT) AS topped, CAST(sum((contributed AND na = 3)::INT) AS BIGINT) AS completed FROM t GROUP BY 1""")
def source_accounting(spark, d):
    """What a fallback source added to each side, by the ids before and after it."""
    from asofkit.functions.rules import side_source

    ev = events(spark, d).filter("event_type IN ('view', 'click', 'error')")
    slot = (F.col("k") % 12)
    b = ev.groupBy("user_id", "d").agg(F.collect_set(F.when(F.col("event_type") == "view", slot)).alias("before"), F.collect_set(slot).alias("after"))
    c = b.select("d", side_source(F.col("before"), F.col("after"), 3).alias("s"))
    return c.groupBy("d").agg(F.count(F.lit(1)).alias("sides"), *[F.count_if(F.col(f"s.{x}")).alias(x) for x in ("contributed", "fully", "topped", "completed")])


RISK = f"""{PA}, st AS (SELECT pitcher, d, count(*) AS np, sum(qty) AS outs FROM pa GROUP BY 1, 2),
rg AS (SELECT *, date_diff('day', lag(d) OVER w, d) AS gap, coalesce(lag(np) OVER w < 2, FALSE)::INT AS ramp, coalesce(lag(outs) OVER w <= 12, FALSE)::INT AS short FROM st WINDOW w AS (PARTITION BY pitcher ORDER BY d)),
il AS (SELECT l_suppkey AS pitcher, CAST(l_shipdate AS DATE) AS pd FROM lineitem WHERE l_discount >= 0.1 AND l_linenumber = 1 GROUP BY 1, 2),
fw AS (SELECT rg.*, il.pd FROM rg ASOF LEFT JOIN il ON rg.pitcher = il.pitcher AND rg.d <= il.pd), bw AS (SELECT fw.*, il.pd AS bd FROM fw ASOF LEFT JOIN il ON fw.pitcher = il.pitcher AND fw.d >= il.pd),
m AS (SELECT *, max(seq) OVER (PARTITION BY game, status) AS ol, max(seq) OVER (PARTITION BY game) AS tl FROM pa), h AS (SELECT *, (seq = ol)::INT AS removed FROM m WHERE NOT (seq = ol AND seq = tl))"""
CAUSE = "CASE WHEN removed = 1 THEN CASE WHEN coalesce(date_diff('day', h.d, bw.pd) <= 3, FALSE) THEN 'injury' ELSE 'hook' END ELSE '' END"
RET30 = "coalesce(date_diff('day', bw.bd, h.d) <= 30, FALSE)::INT"


def risk_rows(spark, d):
    """Rows at risk of removal with regime context and the cause of each exit (empty where there is none)."""
    pa = appearances(spark, d)
    st = pa.groupBy("pitcher", "d").agg(F.count(F.lit(1)).alias("np"), F.sum("qty").alias("outs"))
    w = Window.partitionBy("pitcher").orderBy("d")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rg = st.select("pitcher", "d", F.datediff("d", F.lag("d").over(w)).alias("gap"), flag(F.lag("np").over(w) < 2).alias("ramp"), flag(F.lag("outs").over(w) <= 12).alias("short"))
    il = pa.filter("disc >= 0.1 AND seq = 1").select("pitcher", "d").distinct().withColumn("one", F.lit(1))
    rg = asof_join(rg, il, ["pitcher"], [], strict=False, direction="forward", tolerance_days=3, match_date="placed")
    rg = asof_join(rg, il, ["pitcher"], [], strict=False, match_date="act")
    # a game's last row is the last of its sides' last rows, so the rows themselves are joined once
    ends = group_totals(pa.groupBy("game", "status").agg(F.max("seq").alias("ol")), ["game"], tl=F.max("ol"))
    h = null_safe_join(pa, ends, ["game", "status"])
    h = h.filter(~((F.col("seq") == F.col("ol")) & (F.col("seq") == F.col("tl")))).withColumn("removed", (F.col("seq") == F.col("ol")).cast("int"))
    j = h.join(rg, ["pitcher", "d"])
    cause = F.when(F.col("removed") == 1, F.when(F.col("placed").isNotNull(), "injury").otherwise("hook")).otherwise("")
    return j.withColumn("cause", cause).withColumn("il_ret30", flag(F.datediff("d", "act") <= 30))


@query("A22 W2 W4 W17 J4 J5 J9", f"""WITH {RISK}
SELECT ramp, short, CASE WHEN removed = 1 THEN CASE WHEN coalesce(date_diff('day', h.d, bw.pd) <= 3, FALSE) THEN 'injury' ELSE 'hook' END ELSE '' END AS cause, coalesce(date_diff('day', bw.bd, h.d) <= 30, FALSE)::INT AS il_ret30, count(*) AS n, CAST(sum(removed) AS BIGINT) AS removed, round(avg(gap), 4) AS mean_gap
FROM h JOIN bw ON h.pitcher = bw.pitcher AND h.d = bw.d GROUP BY 1, 2, 3, 4""")
def removal_risk_table(spark, d):
    """Rows at risk with regime context and a competing-risk cause for each exit."""
    return risk_rows(spark, d).groupBy("ramp", "short", "cause", "il_ret30").agg(F.count(F.lit(1)).alias("n"), F.sum("removed").alias("removed"), F.round(F.avg("gap"), 4).alias("mean_gap"))


@query("J1", f"""WITH {EV}, lines AS (SELECT unnest([0.5, 1.5, 2.5]) AS line), box AS (SELECT user_id, d, count(*) AS h, count(*) FILTER (WHERE event_type = 'click') AS c FROM ev GROUP BY 1, 2),
hist AS (SELECT user_id, d, sum(h) OVER w AS ph, count(*) OVER w AS pn, sum((h > 0.5)::INT) OVER w AS g1, sum((h > 1.5)::INT) OVER w AS g2, sum((h > 2.5)::INT) OVER w AS g3, h FROM box WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, d, 'H > ' || CAST(line AS VARCHAR) AS market, round((coalesce(CASE line WHEN 0.5 THEN g1 WHEN 1.5 THEN g2 ELSE g3 END, 0) + 2.0) / (pn + 4.0), 6) AS p, (h > line)::INT AS y FROM hist, lines""")
def replay_ledger(spark, d):
    """Every historical date at once: as-of shares per threshold graded against the day's actual."""
    box = events(spark, d).groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("h"))
    w = Window.partitionBy("user_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    lines = (0.5, 1.5, 2.5)
    hist = box.select("user_id", "d", "h", F.count(F.lit(1)).over(w).alias("pn"), *[F.coalesce(F.sum((F.col("h") > x).cast("int")).over(w), F.lit(0)).alias(f"g{i}") for i, x in enumerate(lines)])
    rows = F.explode(F.array(*[F.struct(F.lit(f"H > {x}").alias("market"), ((F.col(f"g{i}") + 2.0) / (F.col("pn") + 4.0)).alias("p"), (F.col("h") > x).cast("int").alias("y")) for i, x in enumerate(lines)]))
    return hist.select("user_id", "d", rows.alias("r")).select("user_id", "d", "r.market", F.round("r.p", 6).alias("p"), "r.y")


