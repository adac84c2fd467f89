"""Forecast evaluation queries over the graded ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.functions.hashing import draw_sql
from asofkit.operators import evaluation as E
from asofkit.operators.scan import exact_quantiles, top_k
from asofkit.plans._roles import CAP, EV, LED, LED_B, PA, appearances, captures, events, ledger, ledger_b, prob_sql
from asofkit.registry import query
from asofkit.session import cut_lineage


def r6(df, *keep, n=6):
    return df.select(*keep, *[F.round(c, n).alias(c) for c in df.columns if c not in keep])


CLIP = "least(greatest({}, 1e-6), 1 - 1e-6)"


def ll_sql(y: str, p: str) -> str:
    q = CLIP.format(p)
    return f"-({y} * ln({q}) + (1 - {y}) * ln(1 - {q}))"


def logit_sql(p: str, eps: str = "1e-6") -> str:
    q = f"least(greatest({p}, {eps}), 1 - {eps})"
    return f"(CASE WHEN {p} IS NOT NULL THEN ln({q}) - ln(1 - {q}) END)"


def newton_sql(cells: str, keys: str, iters: int, prefix: str = "c") -> str:
    """CTEs c0..cN of a two-parameter logistic fit on folded cells (keys, z, n, sy)."""
    on = " AND ".join(f"x.{k} = c.{k}" for k in keys.split(", "))
    ks = ", ".join(f"x.{k}" for k in keys.split(", "))
    out = [f"{prefix}0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM {cells} GROUP BY {keys})"]
    for i in range(iters):
        mu = "(1.0 / (1.0 + exp(-(c.a + c.b * x.z))))"
        out.append(f"""{prefix}{i}s AS (SELECT {ks}, any_value(c.a) AS a, any_value(c.b) AS b, sum(x.n * {mu} * (1 - {mu})) AS h0, sum(x.n * {mu} * (1 - {mu}) * x.z) AS h1,
  sum(x.n * {mu} * (1 - {mu}) * x.z * x.z) AS h2, sum(x.sy - x.n * {mu}) AS g0, sum((x.sy - x.n * {mu}) * x.z) AS g1 FROM {cells} x JOIN {prefix}{i} c ON {on} GROUP BY {ks}),
{prefix}{i + 1} AS (SELECT {keys}, a + CASE WHEN abs(h0*h2 - h1*h1) >= 1e-12 THEN (h2*g0 - h1*g1) / (h0*h2 - h1*h1) ELSE 0 END AS a, b + CASE WHEN abs(h0*h2 - h1*h1) >= 1e-12 THEN (h0*g1 - h1*g0) / (h0*h2 - h1*h1) ELSE 0 END AS b FROM {prefix}{i}s)""")
    return ",\n".join(out)


def boot_sql(daily: str, group: str, reps: int, num: str, den: str, name: str = "boot", seed: int = 7) -> str:
    return f"""{name}_i AS (SELECT {group}, d, row_number() OVER (PARTITION BY {group} ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS nd FROM {daily}),
{name}_w AS (SELECT {group}, rep, {draw_sql('rep', 'i', 'nd', seed)} AS j FROM {name}_i, (SELECT unnest(generate_series(1, {reps})) AS rep)),
{name} AS (SELECT w.{group} AS {group}, w.rep, sum(x.{num}) * 1.0 / sum(x.{den}) AS stat FROM {name}_w w JOIN {name}_i k ON w.{group} = k.{group} AND w.j = k.i JOIN {daily} x ON x.{group} = k.{group} AND x.d = k.d GROUP BY 1, 2)"""


@query("A27 A51", f"""
WITH {LED}, g AS (SELECT family, market, grouping(family) AS gf, grouping(market) AS gm, count(*) AS n, avg({ll_sql('y', 'p')}) AS ll, avg((p - y) * (p - y)) AS brier, avg(y) AS base, avg(p) AS mean_p
  FROM led GROUP BY GROUPING SETS ((), (family), (family, market)))
SELECT CASE WHEN gf = 1 THEN 'ALL' WHEN gm = 1 THEN 'family' ELSE 'market' END AS grain, coalesce(family, 'ALL') AS family, coalesce(market, 'ALL') AS market, n, round(ll, 6) AS ll, round(brier, 6) AS brier,
 round(base, 6) AS base, round(mean_p, 6) AS mean_p, round(-(base * ln(base) + (1 - base) * ln(1 - base)), 6) AS base_ll, round(-(base * ln(base) + (1 - base) * ln(1 - base)) - ll, 6) AS gain FROM g""")
def skill_ledger(spark, d):
    return r6(E.skill_report(ledger(spark, d)), "grain", "family", "market", "n")


@query("A28", f"""
WITH {LED}, r AS (SELECT family, y, rank() OVER (PARTITION BY family ORDER BY p) + (count(*) OVER (PARTITION BY family, p) - 1) / 2.0 AS rk FROM led)
SELECT family, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1""")
def auc_by_family(spark, d):
    return r6(E.auc(E.value_counts(ledger(spark, d), ["family"]), ["family"]), "family")


@query("A29", f"""
WITH {LED}, e AS (SELECT family, quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q FROM led GROUP BY 1),
b AS (SELECT led.family, p, y, len(list_distinct(list_filter(q[2:], lambda x: x < p AND x > q[1]))) AS bin FROM led JOIN e ON led.family = e.family),
g AS (SELECT family, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1, 2)
SELECT family, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM g GROUP BY 1""")
def calibration_error(spark, d):
    return r6(E.ece(ledger(spark, d), ["family"]), "family")


@query("A29 L1", f"""
WITH {LED}, s AS (SELECT market, quantile_cont(p, [0.05, 0.5, 0.95]) AS q FROM led GROUP BY 1)
SELECT market, CAST(unnest([0.05, 0.5, 0.95]) AS DOUBLE) AS prob, round(unnest(q), 6) AS quantile FROM s""")
def exact_quantiles_by_market(spark, d):
    """Interpolated quantiles without collecting a market in one task."""
    return r6(exact_quantiles(ledger(spark, d), ["market"], "p", [0.05, 0.5, 0.95], E.probability_chunk("p")), "market", "prob")


@query("A30", f"""
WITH {LED} SELECT family, CAST(floor((p - 0.5) / 0.05) AS INT) AS band, count(*) AS n, round(avg(p), 6) AS stated, round(avg(y), 6) AS hit, round(avg(y) - avg(p), 6) AS gap FROM led WHERE p >= 0.5 GROUP BY 1, 2""")
def reliability_ladder(spark, d):
    return r6(E.reliability(ledger(spark, d), ["family"]), "family", "band", "n")


CLOSE = f"fair AS (SELECT entity, d, market, avg({prob_sql('over')} / ({prob_sql('over')} + {prob_sql('under')})) AS p_close FROM cap WHERE over IS NOT NULL AND under IS NOT NULL GROUP BY 1, 2, 3)"


@query("A31", f"""
WITH {EV}, {CAP}, {LED}, {CLOSE}, j AS (SELECT led.y, led.p, f.p_close, led.p - f.p_close AS edge FROM led JOIN (SELECT entity, d, avg(p_close) AS p_close FROM fair GROUP BY 1, 2) f ON led.entity = f.entity AND led.d = f.d)
SELECT (edge > -0.1)::INT + (edge > -0.05)::INT + (edge > -0.03)::INT + (edge > 0.03)::INT + (edge > 0.05)::INT + (edge > 0.1)::INT AS bucket, count(*) AS n, round(avg(y), 6) AS realized, round(avg(p_close), 6) AS implied, round(avg(p), 6) AS stated FROM j GROUP BY 1""")
def edge_buckets(spark, d):
    from asofkit.functions.odds import no_vig

    fair = captures(spark, d).withColumn("f", no_vig("over", "under")).filter("f IS NOT NULL").groupBy("entity", "d", "market").agg(F.avg("f").alias("f"))
    f = fair.groupBy("entity", "d").agg(F.avg("f").alias("p_close"))
    j = ledger(spark, d).join(f, ["entity", "d"])
    r = j.groupBy(E.edge_bucket(F.col("p") - F.col("p_close")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("realized"), F.avg("p_close").alias("implied"), F.avg("p").alias("stated"))
    return r6(r, "bucket", "n")


REPS = 500


@query("A32 U5", f"""
WITH {LED}, daily AS (SELECT family, d, sum({ll_sql('y', '0.5')} - {ll_sql('y', 'p')}) AS s, count(*) AS n FROM led GROUP BY 1, 2),
{boot_sql('daily', 'family', REPS, 's', 'n')}
SELECT family, round(quantile_cont(stat, 0.05), 6) AS ci_lo, round(quantile_cont(stat, 0.95), 6) AS ci_hi, round(avg((stat <= 0)::INT), 6) AS p_one, round(least(2 * least(avg((stat <= 0)::INT), avg((stat >= 0)::INT)), 1), 6) AS p_two FROM boot GROUP BY 1""")
def date_block_bootstrap(spark, d):
    gain = P.log_loss("y", F.lit(0.5)) - P.log_loss("y", "p")
    day = ledger(spark, d).groupBy("family", "d").agg(F.sum(gain).alias("s"), F.count(F.lit(1)).alias("n"))
    return r6(E.bootstrap_summary(E.block_bootstrap(day, ["family"], "d", "s", "n", REPS), ["family"]), "family")


@query("A33", f"""
WITH {LED}, r AS (SELECT market, 1.0 / (1.0 + abs(avg(y) - avg(p)) * 40) AS p_raw FROM led GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p_raw, market) AS rk, count(*) OVER () AS m FROM r)
SELECT market, round(p_raw, 6) AS p_raw, round(least(min(p_raw * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_bh FROM k""")
def bh_adjustment(spark, d):
    r = ledger(spark, d).groupBy("market").agg((1.0 / (1.0 + F.abs(F.avg("y") - F.avg("p")) * 40)).alias("p_raw"))
    return r6(E.bh_adjust(r, "p_raw", "market"), "market")


PAIR = f"""m AS (SELECT a.d, a.family, a.market, {ll_sql('a.y', 'a.p')} AS la, {ll_sql('b.y', 'b.p')} AS lb FROM led a JOIN led_b b ON a.game = b.game AND a.market = b.market AND a.entity = b.entity WHERE a.y = b.y)"""


@query("A34 J16 A32 A33 A51", f"""
WITH {LED}, {LED_B}, {PAIR}, mm AS (SELECT family, d, la, lb FROM m UNION ALL SELECT 'ALL', d, la, lb FROM m), day AS (SELECT family, d, sum(la - lb) AS s, count(*) AS n, sum(la) AS sa, sum(lb) AS sb FROM mm GROUP BY 1, 2),
{boot_sql('day', 'family', REPS, 's', 'n')}, ci AS (SELECT family, quantile_cont(stat, 0.05) AS ci_lo, quantile_cont(stat, 0.95) AS ci_hi, least(2 * least(avg((stat <= 0)::INT), avg((stat >= 0)::INT)), 1) AS p_raw FROM boot GROUP BY 1),
t AS (SELECT family, CAST(sum(n) AS BIGINT) AS n, sum(sa) / sum(n) AS ll_a, sum(sb) / sum(n) AS ll_b, sum(s) / sum(n) AS delta FROM day GROUP BY 1),
k AS (SELECT family, p_raw, row_number() OVER (ORDER BY p_raw, family) AS rk, count(*) OVER () AS nf FROM ci WHERE family <> 'ALL'),
q AS (SELECT family, least(min(p_raw * nf / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS p_bh FROM k)
SELECT t.family, t.n, round(ll_a, 6) AS ll_a, round(ll_b, 6) AS ll_b, round(delta, 6) AS delta, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(p_raw, 6) AS p_raw, round(p_bh, 6) AS p_bh,
 CASE WHEN t.family = 'ALL' THEN '' WHEN t.n < 800 THEN 'INSUFFICIENT n' WHEN p_bh < 0.05 AND ci_lo > 0 THEN 'B BETTER' WHEN p_bh < 0.05 AND ci_hi < 0 THEN 'A BETTER' ELSE 'TIE' END AS verdict
FROM t JOIN ci ON t.family = ci.family LEFT JOIN q ON t.family = q.family""")
def paired_ab_report(spark, d):
    pairs = E.pair_ledgers(ledger(spark, d), ledger_b(spark, d), ["game", "market", "entity"])
    return r6(E.ab_report(pairs, REPS), "family", "n", "verdict")


@query("A34 J16", f"""WITH {LED}, {LED_B}, {PAIR} SELECT family, market, count(*) AS n, round(avg(la - lb), 6) AS delta FROM m GROUP BY 1, 2""")
def ab_market_deltas(spark, d):
    pairs = E.pair_ledgers(ledger(spark, d), ledger_b(spark, d), ["game", "market", "entity"])
    return pairs.groupBy("family", "market").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("delta"))


@query("A38", f"""
WITH {EV} SELECT d, count(*) AS n, CAST(sum(((event_id * 1103515245 + user_id * 12345 + 7) % 2147483648)) % 1000000007 AS BIGINT) AS sig FROM ev GROUP BY 1""")
def day_fingerprint(spark, d):
    """Order-free signature of a day's rows, used as a cache key."""
    h = (F.col("event_id") * 1103515245 + F.col("user_id") * 12345 + 7) % 2147483648
    return events(spark, d).groupBy("d").agg(F.count(F.lit(1)).alias("n"), (F.sum(h.cast("decimal(38,0)")) % 1000000007).cast("long").alias("sig"))


@query("A39 X26 P7", f"""
WITH {PA}, c AS (SELECT pitcher, game, count(*) AS c FROM pa GROUP BY 1, 2), s AS (SELECT pitcher, count(*) AS n, avg(c) AS m, var_pop(c) AS v, sum((c > 1)::INT) AS h1, sum((c > 2)::INT) AS h2 FROM c GROUP BY 1)
SELECT pitcher, n, round(m, 6) AS mean, round(v, 6) AS var, h1, h2 FROM s""")
def draw_moments(spark, d):
    c = appearances(spark, d).groupBy("pitcher", "game").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.var_pop("c"), 6).alias("var"),
                                    F.count_if(F.col("c") > 1).alias("h1"), F.count_if(F.col("c") > 2).alias("h2"))


def _tail_sql(k: int) -> str:
    """Tail above k of a Poisson, or of a negative binomial when over-dispersed, as written-out terms."""
    pois = " + ".join(f"exp(-m) * power(m, {i}) / {[1, 1, 2, 6, 24, 120][i]}" for i in range(k + 1))
    r, q = "(m*m/(v-m))", "((m*m/(v-m)) / ((m*m/(v-m)) + m))"
    nb, term = [], f"power({q}, {r})"
    for i in range(k + 1):
        if i:
            term = f"({term} * ({i} - 1 + {r}) / {i} * (1 - {q}))"
        nb.append(term)
    return f"CASE WHEN v > m * 1.0001 THEN 1 - ({' + '.join(nb)}) ELSE 1 - ({pois}) END"


@query("A39 U4", f"""
WITH {EV}, c AS (SELECT user_id, k % 5 AS c FROM ev), s AS (SELECT user_id, count(*) AS n, avg(c) AS m, var_pop(c) AS v, sum((c > 1)::INT) AS h1, sum((c > 3)::INT) AS h3 FROM c GROUP BY 1)
SELECT user_id, round((h1 + 64.0 * greatest(0, {_tail_sql(1)})) / (n + 64.0), 6) AS p_over_1_5, round((h3 + 64.0 * greatest(0, {_tail_sql(3)})) / (n + 64.0), 6) AS p_over_3_5 FROM s""")
def tail_probability(spark, d):
    """Share of draws above a line, shrunk by 64 pseudo-draws to the moment-matched count law."""
    c = events(spark, d).select("user_id", (F.col("k") % 5).alias("c"))
    s = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("m"), F.var_pop("c").alias("v"),
                                 F.count_if(F.col("c") > 1).alias("h1"), F.count_if(F.col("c") > 3).alias("h3"))
    p = lambda h, k: F.round((F.col(h) + 64.0 * P.count_tail("m", "v", k)) / (F.col("n") + 64.0), 6)
    return s.select("user_id", p("h1", 1).alias("p_over_1_5"), p("h3", 3).alias("p_over_3_5"))


@query("A40", f"""WITH {EV}, g AS (SELECT user_id, event_type, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY 1, 2) SELECT event_type, round(sqrt(avg(v) + var_samp(m)), 6) AS sd FROM g GROUP BY 1""")
def total_variance_sd(spark, d):
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return g.groupBy("event_type").agg(F.round(F.sqrt(F.avg("v") + F.var_samp("m")), 6).alias("sd"))


def _goal_sql(reps: int) -> str:
    return f"""
WITH {LED}, rk AS (SELECT market, d, p, y, row_number() OVER (PARTITION BY market, d ORDER BY p DESC, game) AS rn FROM led),
hits AS (SELECT market, avg(y) FILTER (WHERE rn <= 1) AS t1, avg(y) FILTER (WHERE rn <= 3) AS t3, avg(p) FILTER (WHERE rn <= 10) AS t10s, avg(y) FILTER (WHERE rn <= 10) AS t10 FROM rk GROUP BY 1),
base AS (SELECT market, count(*) AS n, avg(y) AS base, count(*) FILTER (WHERE p > 0.5) AS hi_n, avg(p) FILTER (WHERE p > 0.5) AS hi_s, avg(y) FILTER (WHERE p > 0.5) AS hi_h FROM led GROUP BY 1),
ranks AS (SELECT market, y, rank() OVER (PARTITION BY market ORDER BY p) + (count(*) OVER (PARTITION BY market, p) - 1) / 2.0 AS rk FROM led),
au AS (SELECT market, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM ranks GROUP BY 1),
slate AS (SELECT market, d, sum(y) AS ht, count(*) AS ct FROM led GROUP BY 1, 2), dep AS (SELECT unnest(generate_series(1, 15)) AS depth),
cum AS (SELECT market, d, depth, sum(y) AS h, count(*) AS c FROM rk JOIN dep ON rn <= depth GROUP BY 1, 2, 3),
si AS (SELECT market, d, row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY market) AS nd FROM slate),
w AS (SELECT market, rep, {draw_sql('rep', 'i', 'nd', 7)} AS j FROM si, (SELECT unnest(generate_series(1, {reps})) AS rep) WHERE nd >= 8),
bs AS (SELECT w.market, w.rep, cum.depth, sum(cum.h) AS h, sum(cum.c) AS c, sum(slate.ht) AS ht, sum(slate.ct) AS ct FROM w JOIN si ON w.market = si.market AND w.j = si.i
  JOIN slate ON slate.market = si.market AND slate.d = si.d JOIN cum ON cum.market = si.market AND cum.d = si.d GROUP BY 1, 2, 3),
o AS (SELECT market, depth, rep, {CLIP.format('(h * 1.0 / c)')} AS pr, {CLIP.format('(ht * 1.0 / ct)')} AS br FROM bs),
l AS (SELECT market, depth, quantile_cont((pr / (1 - pr)) / (br / (1 - br)), 0.10) AS lcb FROM o GROUP BY 1, 2), td AS (SELECT market, max(depth) AS depth FROM l WHERE lcb >= 1.5 GROUP BY 1)
SELECT base.market, n, round(base, 6) AS base, round(auc, 6) AS auc, round(t1, 6) AS t1_hit, round(t3, 6) AS t3_hit, round(t10s, 6) AS t10_stated, round(t10, 6) AS t10_hit, round(t10 - t10s, 6) AS t10_gap,
 hi_n, round(hi_s, 6) AS hi_stated, round(hi_h, 6) AS hi_hit, CAST(coalesce(depth, 0) AS INT) AS trust_depth
FROM base JOIN hits USING (market) JOIN au USING (market) LEFT JOIN td USING (market)"""


@query("A41 W21 A44 L2", _goal_sql(300))
def goal_board(spark, d):
    return r6(E.goal_board(ledger(spark, d), ["market"], "d", [F.asc("game")], reps=300), "market", "n", "hi_n", "trust_depth")


@query("A42", f"""
WITH {LED}, rk AS (SELECT market, d, p, y, row_number() OVER (PARTITION BY market, d ORDER BY p DESC, game) AS rn FROM led),
t AS (SELECT market, d, avg(y) FILTER (WHERE rn <= 1) AS t1, avg(y) FILTER (WHERE rn <= 3) AS t3, avg(y) FILTER (WHERE rn <= 5) AS t5, avg(y) FILTER (WHERE rn <= 10) AS t10, avg(p) FILTER (WHERE rn <= 10) AS stated,
 {logit_sql('max(p) FILTER (WHERE rn = 1)')} - {logit_sql('max(p) FILTER (WHERE rn = 2)')} AS margin FROM rk WHERE rn <= 10 GROUP BY 1, 2)
SELECT market, count(*) AS slates, round(avg(t1), 6) AS t1, round(avg(t3), 6) AS t3, round(avg(t5), 6) AS t5, round(avg(t10), 6) AS t10, round(avg(stated), 6) AS stated, round(median(margin), 6) AS med_margin FROM t GROUP BY 1""")
def topk_tracker(spark, d):
    """Per slate and market, then pooled with the median margin (one value per slate)."""
    t = top_k(ledger(spark, d), ["market", "d"], [F.desc("p"), F.asc("game")], 10)
    at = lambda c, n: F.avg(F.when(F.col("rn") <= n, F.col(c)))
    m = P.logit(F.max(F.when(F.col("rn") == 1, F.col("p")))) - P.logit(F.max(F.when(F.col("rn") == 2, F.col("p"))))
    s = t.groupBy("market", "d").agg(*[at("y", n).alias(f"t{n}") for n in (1, 3, 5, 10)], at("p", 10).alias("stated"), m.alias("margin"))
    r = s.groupBy("market").agg(F.count(F.lit(1)).alias("slates"), *[F.avg(c).alias(c) for c in ("t1", "t3", "t5", "t10", "stated")], F.percentile("margin", F.lit(0.5)).alias("med_margin"))
    return r6(r, "market", "slates")


@query("A43", f"""
WITH {LED}, {LED_B}, j AS (SELECT a.market, a.d, a.game, a.y, a.p AS pm, b.p * 0.5 + ((a.game * 31) % 100) / 200.0 AS pc, ((a.game * 17) % 100) / 100.0 AS po FROM led a JOIN led_b b USING (game)),
r AS (SELECT *, row_number() OVER (PARTITION BY market, d ORDER BY pm DESC, game) AS rm, row_number() OVER (PARTITION BY market, d ORDER BY pc DESC, game) AS rc, row_number() OVER (PARTITION BY market, d ORDER BY po DESC, game) AS ro FROM j),
s AS (SELECT market, d, avg(y) FILTER (WHERE rm <= 3) AS m, avg(y) FILTER (WHERE rc <= 3) AS c, avg(y) FILTER (WHERE ro <= 3) AS o FROM r GROUP BY 1, 2)
SELECT market, count(*) AS slates, round(avg(m), 6) AS model, round(avg(c), 6) AS "close", round(avg(o), 6) AS "open", CAST(sum((m > c)::INT) AS BIGINT) AS wins, CAST(sum((m < c)::INT) AS BIGINT) AS losses FROM s GROUP BY 1""")
def model_vs_market_topk(spark, d):
    """One universe ranked three ways; daily hit rates and a sign count."""
    a, b = ledger(spark, d), ledger_b(spark, d).select("game", F.col("p").alias("pb"))
    j = a.join(b, "game").select("market", "d", "game", "y", F.col("p").alias("model"),
                                 (F.col("pb") * 0.5 + ((F.col("game") * 31) % 100) / 200.0).alias("close"), (((F.col("game") * 17) % 100) / 100.0).alias("open"))
    out = None
    for c in ("model", "close", "open"):
        s = top_k(j, ["market", "d"], [F.desc(c), F.asc("game")], 3).groupBy("market", "d").agg(F.avg("y").alias(f"h_{c}"))
        out = s if out is None else out.join(s, ["market", "d"])
    r = out.groupBy("market").agg(F.count(F.lit(1)).alias("slates"), *[F.avg(f"h_{c}").alias(c) for c in ("model", "close", "open")],
                                  F.count_if(F.col("h_model") > F.col("h_close")).alias("wins"), F.count_if(F.col("h_model") < F.col("h_close")).alias("losses"))
    return r6(r, "market", "slates", "wins", "losses")


@query("A44", f"""
WITH {LED}, b AS (SELECT family, avg(y) AS base FROM led GROUP BY 1), t AS (SELECT family, avg(y) AS h FROM (SELECT *, row_number() OVER (PARTITION BY family, d ORDER BY p DESC, game) AS rn FROM led) WHERE rn <= 10 GROUP BY 1),
c AS (SELECT family, avg(((p >= 0.5) = (y = 1))::INT) AS h1 FROM (SELECT *, row_number() OVER (PARTITION BY family, d ORDER BY greatest(p, 1 - p) DESC, game) AS rn FROM led) WHERE rn = 1 GROUP BY 1)
SELECT family, round(h / base, 6) AS lift, round((least(h, 1 - 1e-6) / (1 - least(h, 1 - 1e-6))) / (base / (1 - base)), 6) AS or_lift, round(h1 / base, 6) AS top1_lift FROM b JOIN t USING (family) JOIN c USING (family)""")
def selection_lift(spark, d):
    led = ledger(spark, d).withColumn("conf", F.greatest("p", 1 - F.col("p")))
    base = led.groupBy("family").agg(F.avg("y").alias("base"))
    t = top_k(led, ["family", "d"], [F.desc("p"), F.asc("game")], 10).groupBy("family").agg(F.avg("y").alias("h"))
    c = top_k(led, ["family", "d"], [F.desc("conf"), F.asc("game")], 1).groupBy("family").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("h1"))
    j = base.join(t, "family").join(c, "family")
    lift = F.col("h") / F.col("base")
    return r6(j.select("family", lift.alias("lift"), P.odds_ratio_lift(lift, F.col("base")).alias("or_lift"), (F.col("h1") / F.col("base")).alias("top1_lift")), "family")


#: Steps of the oracle's unrolled Newton fits; enough to settle, as the operator's own test on the step does.
NIT = 14


@query("M5 U1", f"""
WITH {LED}, cells AS (SELECT family, {logit_sql('p')} AS z, count(*) AS n, sum(y) AS sy FROM led GROUP BY 1, 2), {newton_sql('cells', 'family', NIT)}
SELECT family, (SELECT count(*) FROM led l WHERE l.family = c{NIT}.family) AS n, round(a, 5) AS a, round(b, 5) AS b FROM c{NIT} WHERE b > 0 AND (SELECT count(*) FROM led l WHERE l.family = c{NIT}.family) >= 500""")
def platt_by_family(spark, d):
    return r6(E.platt_maps(ledger(spark, d), ["family"], 500), "family", "n", n=5)


@query("M5", f"""
WITH {LED}, cells AS (SELECT family, {logit_sql('p')} AS z, count(*) AS n, sum(y) AS sy FROM led GROUP BY 1, 2), {newton_sql('cells', 'family', NIT)},
lcells AS (SELECT family, market, {logit_sql('p')} AS z, count(*) AS n, sum(y) AS sy FROM led GROUP BY 1, 2, 3), {newton_sql('lcells', 'family, market', NIT, 'm')},
ln_ AS (SELECT * FROM m{NIT} JOIN (SELECT family AS f2, market AS m2, count(*) AS n FROM led GROUP BY 1, 2) ON family = f2 AND market = m2 WHERE n >= 680 AND b > 0), fam AS (SELECT * FROM c{NIT} WHERE b > 0 AND family <> 'view' AND family IN (SELECT family FROM led GROUP BY 1 HAVING count(*) >= 500))
SELECT led.game, CASE WHEN ln_.a IS NOT NULL THEN 'line' WHEN fam.a IS NOT NULL THEN 'family' ELSE 'identity' END AS cal_via,
 round(CASE WHEN coalesce(ln_.a, fam.a) IS NULL THEN p ELSE 1.0 / (1.0 + exp(-(coalesce(ln_.a, fam.a) + coalesce(ln_.b, fam.b) * {logit_sql('p')}))) END, 5) AS p_cal
FROM led LEFT JOIN ln_ ON led.family = ln_.family AND led.market = ln_.market LEFT JOIN fam ON led.family = fam.family""")
def calibration_precedence(spark, d):
    """Line map, then family map, then identity."""
    led = ledger(spark, d)
    fam = E.platt_maps(led, ["family"], 500).filter("family <> 'view'")
    lin = E.platt_maps(led, ["family", "market"], 680)
    return E.calibrated(led, fam, lin, "family", "market").select("game", "cal_via", F.round("p_cal", 5).alias("p_cal"))


@query("M6", f"""
WITH {LED}, fit AS (SELECT family, min(d) AS fit_start, max(d) FILTER (WHERE d < DATE '2024-01-20') AS fit_end FROM led GROUP BY 1),
ev2 AS (SELECT family, min(d) AS e0, max(d) AS e1 FROM led WHERE d >= DATE '2024-01-15' + CAST(length(family) AS INT) - 5 GROUP BY 1)
SELECT family, fit_start, fit_end, e0 AS eval_start, e1 AS eval_end, NOT (e1 < fit_start OR e0 > fit_end) AS overlaps, fit_end + 1 AS auto_start FROM fit JOIN ev2 USING (family)""")
def in_sample_guard(spark, d):
    led = ledger(spark, d)
    fit = led.filter("d < DATE'2024-01-20'").groupBy("family").agg(F.min("d").alias("fit_start"), F.max("d").alias("fit_end"))
    cut = F.expr("date_add(DATE'2024-01-15', length(family) - 5)")
    e = led.filter(F.col("d") >= cut).groupBy("family").agg(F.min("d").alias("eval_start"), F.max("d").alias("eval_end"))
    from asofkit.operators.quality import fit_overlap
    return fit_overlap(fit.join(e, "family"))


def _crossfit_sql() -> str:
    z = logit_sql("least(greatest(p, 1e-4), 1 - 1e-4)", "1e-4")
    return f"""
WITH {LED}, di AS (SELECT family, d, (row_number() OVER (PARTITION BY family ORDER BY d) - 1) % 5 AS fold FROM (SELECT DISTINCT family, d FROM led)),
l AS (SELECT led.*, fold, {z} AS z FROM led JOIN di USING (family, d)), f5 AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
tr AS (SELECT l.family, f5.fold, z, count(*) AS n, sum(y) AS sy FROM l JOIN f5 ON l.fold <> f5.fold GROUP BY 1, 2, 3), {newton_sql('tr', 'family, fold', NIT)}
SELECT l.game, l.fold, round(least(greatest(CASE WHEN t.n >= 300 AND b > 0 THEN 1.0 / (1.0 + exp(-(a + b * z))) ELSE p END, 1e-4), 1 - 1e-4), 5) AS p_cal FROM l JOIN c{NIT} c ON l.family = c.family AND l.fold = c.fold
JOIN (SELECT family, fold, sum(n) AS n FROM tr GROUP BY 1, 2) t ON l.family = t.family AND l.fold = t.fold"""


@query("M7", _crossfit_sql())
def crossfit_calibration(spark, d):
    r = E.crossfit_calibration(ledger(spark, d), "family", "d", 5, 300)
    return r.select("game", "fold", F.round("p_cal", 5).alias("p_cal"))


CREPS = 300


def composite(led, reps):
    """Bootstrapped composite score per family from per-day, per-value counts."""
    day = led.groupBy("family", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(P.log_loss("y", "p")).alias("nll"))
    picks = top_k(led, ["family", "d"], [F.desc("p"), F.asc("game")], 10).groupBy("family", "d").agg(F.sum("y").alias("ky"), F.count(F.lit(1)).alias("kn"))
    day = cut_lineage(day)
    w = cut_lineage(E.day_weights(E.slate_index(day, ["family"], "d"), ["family"], "d", reps, 11))
    ws = lambda c: F.sum(F.col(c) * F.col("w"))
    s = day.join(picks, ["family", "d"]).join(w, ["family", "d"]).groupBy("family", "rep").agg(*[ws(c).alias(c) for c in ("n", "sy", "nll", "ky", "kn")])
    counts = cut_lineage(E.value_counts(led, ["family", "d"]))
    k = ["family", "rep"]
    cells = E.resampled_cells(counts, w, ["family"], "d")
    # replicates start where the fit of all days ends
    whole = counts.groupBy("family", P.logit("p").alias("z")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("sy"))
    whole = E.logistic_fits(whole, ["family"], "z", "n", "sy", keep_unsettled=True)
    start = w.select(*k).distinct().join(whole, "family").select(*k, F.when(F.col("settled"), F.col("a")).otherwise(0.0).alias("a"), F.when(F.col("settled"), F.col("b")).otherwise(1.0).alias("b"))
    fit = E.logistic_fits(cells.select(*k, "z", "n", F.col("pos").alias("sy")), k, "z", "n", "sy", start=start, keep_unsettled=True, written=True)
    j = s.join(E.auc_and_ece(cells, k), k).join(fit, k)
    base = F.col("sy") / F.col("n")
    ent = P.entropy2(base)
    rel = 100 * (ent - F.col("nll") / F.col("n")) / ent
    lift = P.odds_ratio_lift((F.col("ky") / F.col("kn")) / base, base)
    score = P.composite_score(rel, F.col("auc"), F.col("ece") / (base * (1 - base)), F.col("b"), lift, F.lit(None).cast("double"))
    return j.select(*k, score.alias("score"), "settled")


def _composite_sql() -> str:
    un = lambda x: f"greatest(0.0, least(1.0, {x}))"
    return f"""
WITH {LED}, day AS (SELECT family, d, count(*) AS n, sum(y) AS sy, sum({ll_sql('y', 'p')}) AS nll FROM led GROUP BY 1, 2),
pk AS (SELECT family, d, sum(y) AS ky, count(*) AS kn FROM (SELECT *, row_number() OVER (PARTITION BY family, d ORDER BY p DESC, game) AS rn FROM led) WHERE rn <= 10 GROUP BY 1, 2),
si AS (SELECT family, d, row_number() OVER (PARTITION BY family ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY family) AS nd FROM day),
dw AS (SELECT family, rep, {draw_sql('rep', 'i', 'nd', 11)} AS j FROM si, (SELECT unnest(generate_series(1, {CREPS})) AS rep)),
w AS (SELECT dw.family, dw.rep, si.d, count(*) AS w FROM dw JOIN si ON dw.family = si.family AND dw.j = si.i GROUP BY 1, 2, 3),
s AS (SELECT w.family, w.rep, sum(day.n * w) AS n, sum(day.sy * w) AS sy, sum(nll * w) AS nll, sum(ky * w) AS ky, sum(kn * w) AS kn FROM w JOIN day USING (family, d) JOIN pk USING (family, d) GROUP BY 1, 2),
cells0 AS (SELECT w.family, w.rep, p, sum(y * w) AS pos, sum((1 - y) * w) AS neg FROM led JOIN w USING (family, d) GROUP BY 1, 2, 3),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY family, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos + neg) OVER (PARTITION BY family, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(pos + neg) OVER (PARTITION BY family, rep) AS tw FROM cells0),
au AS (SELECT family, rep, sum(below * pos + 0.5 * pos * neg) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY 1, 2),
bn AS (SELECT family, rep, least(CAST(floor(10.0 * cw / tw) AS INT), 9) AS b, sum(pos + neg) AS sw, sum((pos + neg) * p) AS sp, sum(pos) AS sy FROM cu GROUP BY 1, 2, 3), ec AS (SELECT family, rep, sum(abs(sp - sy)) / sum(sw) AS ece FROM bn GROUP BY 1, 2),
cells AS (SELECT family, rep, {logit_sql('p')} AS z, pos + neg AS n, pos AS sy FROM cells0), {newton_sql('cells', 'family, rep', NIT)},
q AS (SELECT s.family, s.rep, s.sy * 1.0 / s.n AS base, s.nll / s.n AS ll, (s.ky * 1.0 / s.kn) AS top, auc, ece, b AS slope FROM s JOIN au USING (family, rep) JOIN ec USING (family, rep) JOIN c{NIT} USING (family, rep)),
e AS (SELECT *, -(base * ln(base) + (1 - base) * ln(1 - base)) AS ent, (least(top, 1 - 1e-6) / (1 - least(top, 1 - 1e-6))) / (base / (1 - base)) AS orl FROM q),
sc AS (SELECT family, rep, 100 * (0.4 * {un('100 * (ent - ll) / ent / 8.0')} + 0.2 * {un('(auc - 0.5) / 0.2')} + 0.2 * (0.5 * {un('1 - (ece / (base * (1 - base))) / 0.1')} + 0.5 * {un('1 - abs(slope - 1) / 0.5')}) + 0.1 * {un('(orl - 1) / 1.5')}) / 0.9 AS score FROM e)
SELECT family, round(avg(score), 4) AS score_mean, round(quantile_cont(score, 0.10), 4) AS score_lo, count(*) AS replicates, CAST(0 AS BIGINT) AS unsettled,
 CASE WHEN quantile_cont(score, 0.10) >= 72 THEN '1 ELITE' WHEN quantile_cont(score, 0.10) >= 60 THEN '2 STRONG' WHEN quantile_cont(score, 0.10) >= 48 THEN '3 SOLID' WHEN quantile_cont(score, 0.10) >= 44 THEN '4 DECENT' WHEN quantile_cont(score, 0.10) >= 41 THEN '5 LOW CEILING' ELSE '6 AVOID' END AS tier FROM sc GROUP BY 1"""


@query("A45 U5 A28 A29", _composite_sql())
def composite_score_tiers(spark, d):
    """Score lower bound under day reweighting and the tier it earns."""
    sc = composite(ledger(spark, d), CREPS).groupBy("family").agg(F.avg("score").alias("score_mean"), F.percentile("score", F.lit(0.10)).alias("score_lo"),
                                                               F.count(F.lit(1)).alias("replicates"), F.count_if(~F.col("settled")).alias("unsettled"))
    return sc.select("family", F.round("score_mean", 4).alias("score_mean"), F.round("score_lo", 4).alias("score_lo"), "replicates", "unsettled", P.tier_of("score_lo").alias("tier"))


def _baseline_sql() -> str:
    return f"""
WITH {PA}, tr AS (SELECT * FROM pa WHERE season < 2000), sh AS (SELECT label, count(*) * 1.0 / (SELECT count(*) FROM tr) AS q FROM tr GROUP BY 1),
en AS (SELECT pitcher, label, count(*) AS c FROM tr GROUP BY 1, 2), te AS (SELECT pitcher, label FROM pa WHERE season >= 2000),
m AS (SELECT te.label, sh.q AS ql, (coalesce(en.c, 0) + 100.0 * sh.q) / (t.n + 100.0) AS qe FROM te JOIN sh ON te.label = sh.label LEFT JOIN en ON en.pitcher = te.pitcher AND en.label = te.label JOIN (SELECT pitcher, count(*) AS n FROM tr GROUP BY 1) t ON t.pitcher = te.pitcher)
SELECT label, count(*) AS n, round(avg(-ln(greatest(ql, 1e-9))), 6) AS ll_league, round(avg(-ln(greatest(qe, 1e-9))), 6) AS ll_entity FROM m GROUP BY 1"""


@query("M9 X24", _baseline_sql())
def class_baselines(spark, d):
    """League share and shrunk entity share as class probabilities; multi-class log loss by class."""
    from asofkit.operators.shrink import category_shares

    pa = appearances(spark, d)
    tr, te = pa.filter("season < 2000"), pa.filter("season >= 2000")
    lg = category_shares(tr, [], "label", "q").select("label", "q")
    en = tr.groupBy("pitcher", "label").agg(F.count(F.lit(1)).alias("c"))
    n = tr.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"))
    cells = te.groupBy("pitcher", "label").agg(F.count(F.lit(1)).alias("k")).join(lg, "label").join(en, ["pitcher", "label"], "left").join(n, "pitcher")
    qe = (F.coalesce("c", F.lit(0)) + 100.0 * F.col("q")) / (F.col("n") + 100.0)
    wll = lambda q: F.round(F.sum(-F.log(F.greatest(q, F.lit(1e-9))) * F.col("k")) / F.sum("k"), 6)
    return cells.groupBy("label").agg(F.sum("k").alias("n"), wll(F.col("q")).alias("ll_league"), wll(qe).alias("ll_entity"))


def _fatigue_sql() -> str:
    mu = "(1 / (1 + exp(-(x.o + b.beta * x.f))))"
    steps = ", ".join(f"b{i + 1} AS (SELECT x.cls, any_value(b.beta) + sum(f * (y - {mu})) / sum(f * f * {mu} * (1 - {mu})) AS beta FROM x JOIN b{i} b ON x.cls = b.cls GROUP BY x.cls)" for i in range(14))
    return f"""
WITH {EV}, dd AS (SELECT user_id, d, count(*) AS np FROM ev GROUP BY 1, 2), r0 AS (SELECT e.user_id, coalesce(a.np, 0) AS np1, coalesce(b.np, 0) AS np2, event_type FROM ev e
  LEFT JOIN dd a ON a.user_id = e.user_id AND a.d + 1 = e.d LEFT JOIN dd b ON b.user_id = e.user_id AND b.d + 2 = e.d),
k AS (SELECT user_id, cls, (event_type = cls)::INT AS y, least(np1, 4) / 2.0 + 0.5 * least(np2, 4) / 2.0 AS f FROM r0, (SELECT unnest(['error', 'view', 'click']) AS cls) WHERE np1 < 5 AND NOT (np1 > 2 AND np2 > 2)), lg AS (SELECT cls, avg(y) AS lg FROM k GROUP BY 1),
ba AS (SELECT user_id, k.cls, (sum(y) + 150.0 * any_value(lg)) / (count(*) + 150.0) AS b FROM k JOIN lg ON k.cls = lg.cls GROUP BY 1, 2), x AS (SELECT k.cls, ln(b / (1 - b)) AS o, f, y FROM k JOIN ba ON k.user_id = ba.user_id AND k.cls = ba.cls),
b0 AS (SELECT DISTINCT cls, 0.0::DOUBLE AS beta FROM x), {steps}
SELECT x.cls, round(any_value(b.beta), 5) AS beta, round(1 / sqrt(sum(f * f * {mu} * (1 - {mu}))), 5) AS se, round(any_value(b.beta) * sqrt(sum(f * f * {mu} * (1 - {mu}))), 4) AS z, count(*) AS n FROM x JOIN b14 b ON x.cls = b.cls GROUP BY 1"""


@query("A19 J20", _fatigue_sql())
def fatigue_offset_logistic(spark, d):
    """Log-odds shift per unit of recent use for three classes, with shrunk personal baselines as offsets."""
    from asofkit.operators.joins import exact_lag

    ev = events(spark, d)
    daily = ev.groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("np"))
    r = exact_lag(ev, daily, ["user_id"], "d", "np", [1, 2])
    a, b = F.col("np_lag1"), F.col("np_lag2")
    r = r.filter((a < 5) & ~((a > 2) & (b > 2))).withColumn("f", F.least(a, F.lit(4)) / 2.0 + 0.5 * F.least(b, F.lit(4)) / 2.0)
    r = r.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in ("error", "view", "click")])))
    cells = r.groupBy("user_id", "cls", "f").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == F.col("cls")).cast("int")).alias("sy"))
    lg = cells.groupBy("cls").agg((F.sum("sy") / F.sum("n")).alias("lg"))
    base = cells.groupBy("user_id", "cls").agg(F.sum("sy").alias("s"), F.sum("n").alias("c")).join(lg, "cls")
    base = base.select("user_id", "cls", ((F.col("s") + 150.0 * F.col("lg")) / (F.col("c") + 150.0)).alias("b"))
    cells = cells.join(base, ["user_id", "cls"]).groupBy("cls", "b", "f").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    fit = E.offset_logistic(cells, ["cls"], F.log(F.col("b") / (1 - F.col("b"))), F.col("f"), "n", "sy")
    return fit.join(cells.groupBy("cls").agg(F.sum("n").alias("n")), "cls").select("cls", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), F.round("z", 4).alias("z"), "n")
