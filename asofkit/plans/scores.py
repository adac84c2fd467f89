"""Composite scores per family from the diagnostics of its markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.operators import evaluation as E
from asofkit.operators import market as M
from asofkit.operators.scan import top_k
from asofkit.plans._roles import CAP, EV, LED, ledger
from asofkit.plans.evaluation import draw_sql, ll_sql, logit_sql, newton_sql
from asofkit.plans.market import ARR_T, COMPACT, STORE_SEL, prob_sql, store
from asofkit.registry import query
from asofkit.session import cut_lineage

#: Replicates, cells of the value histogram, least rows of a market and of a family's graded prices.
REPS, GRID, LEAST, LEAST_GATE, STEPS = 300, 200, 100, 800, 14


def close_edge(led, prices, least):
    """Per family how much lower the model's log loss is than the close's; NULL on too few graded prices."""
    r = led.join(prices, ["entity", "mk"]).groupBy("family").agg(F.count(F.lit(1)).alias("n_gate"), F.avg(P.log_loss("y", "pc") - P.log_loss("y", "p")).alias("edge"))
    return r.select("family", "n_gate", F.when(F.col("n_gate") >= least, F.col("edge")).alias("vs_close"))


def market_scores(led, vs, reps, seed, grid=GRID, least=LEAST):
    """Score of every family and replicate (0: the data as they are).

    Days are drawn per family and shared by its markets. Log loss and hits are day sums; rank,
    calibration and slope read values at the middle of their cell of a histogram, so what is
    resampled is days times cells and does not grow with the rows. Diagnostics are averaged over
    the markets, lift is that of the market with the highest base rate.
    """
    fm = ["family", "market"]
    k = [*fm, "rep"]
    day = led.groupBy(*fm, "d").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(P.log_loss("y", "p")).alias("nll"))
    picks = top_k(led, [*fm, "d"], [F.desc("p"), F.asc("game")], 10).groupBy(*fm, "d").agg(F.sum("y").alias("ky"), F.count(F.lit(1)).alias("kn"))
    day = cut_lineage(day.join(picks, [*fm, "d"]))
    sized = day.groupBy(*fm).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy")).filter((F.col("n") >= least) & (F.col("sy") > 0) & (F.col("sy") < F.col("n")))
    sized = cut_lineage(sized.withColumn("base0", F.col("sy") / F.col("n")))
    flagship = sized.groupBy("family").agg(F.max_by("market", F.struct("base0", "market")).alias("flagship"))
    cell = F.least(F.floor(F.col("p") * grid), F.lit(grid - 1))
    hist = led.groupBy(*fm, "d", cell.alias("cell")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    index = E.slate_index(day, ["family"], "d")
    drawn = E.day_weights(index, ["family"], "d", reps, seed).select("family", "rep", "d", "w")
    w = cut_lineage(drawn.unionByName(index.select("family", F.lit(0).alias("rep"), "d", F.lit(1).cast("long").alias("w"))))
    ws = lambda c: F.sum(F.col(c) * F.col("w")).alias(c)
    s = day.join(sized.select(*fm), fm).join(w, ["family", "d"]).groupBy(*k).agg(*[ws(c) for c in ("n", "sy", "nll", "ky", "kn")])
    cells = hist.join(sized.select(*fm), fm).join(w, ["family", "d"]).groupBy(*k, "cell").agg(ws("pos"), ws("neg"))
    cells = cut_lineage(cells.withColumn("p", (F.col("cell") + 0.5) / grid).drop("cell"))
    fit = E.logistic_fits(cells.select(*k, P.logit("p").alias("z"), (F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("sy")), k, "z", "n", "sy", keep_unsettled=True)
    j = s.join(E.auc(cells, k), k).join(E.weighted_ece(cells, k), k).join(fit, k).join(flagship, "family")
    base = F.col("sy") / F.col("n")
    ent = F.nullif(P.entropy2(base), F.lit(0.0))
    d = j.select(*k, "auc", "b", "settled", (100 * (ent - F.col("nll") / F.col("n")) / ent).alias("rel"), F.try_divide(F.col("ece"), base * (1 - base)).alias("ece_rel"),
                 F.when(F.col("market") == F.col("flagship"), P.odds_ratio_lift((F.col("ky") / F.col("kn")) / base, base)).alias("orl"))
    m = d.groupBy("family", "rep").agg(*[F.avg(c).alias(c) for c in ("rel", "auc", "ece_rel", "b")], F.max("orl").alias("orl"), F.count(F.lit(1)).alias("markets"), F.count_if(~F.col("settled")).alias("unsettled"))
    m = m.join(vs, "family", "left")
    return m.withColumn("score", P.composite_score(F.col("rel"), F.col("auc"), F.col("ece_rel"), F.col("b"), F.col("orl"), F.col("vs_close")))


def _sql() -> str:
    un = lambda x: f"greatest(0.0, least(1.0, {x}))"
    pc = f"{prob_sql('close_over')} / ({prob_sql('close_over')} + {prob_sql('close_under')})"
    fmr = "family, market, rep"
    body = f"0.4 * {un('rel / 8.0')} + 0.2 * {un('(auc - 0.5) / 0.2')} + 0.2 * (0.5 * {un('1 - ece / 0.1')} + 0.5 * {un('1 - abs(slope - 1) / 0.5')}) + 0.1 * {un('(orl - 1) / 1.5')}"
    return f"""
WITH {EV}, {CAP}, {LED}, {ARR_T}, {COMPACT}, {STORE_SEL}, fair AS (SELECT entity, market AS mk, median({pc}) AS pc FROM s GROUP BY 1, 2 HAVING median({pc}) IS NOT NULL),
vs AS (SELECT family, count(*) AS n_gate, CASE WHEN count(*) >= {LEAST_GATE} THEN avg({ll_sql('y', 'pc')} - {ll_sql('y', 'p')}) END AS vs_close FROM led JOIN fair f ON led.entity = f.entity AND f.mk = 'm' || CAST(led.game % 2 AS VARCHAR) GROUP BY 1),
sized AS (SELECT family, market, sum(y) * 1.0 / count(*) AS base0 FROM led GROUP BY 1, 2 HAVING count(*) >= {LEAST} AND min(y) < max(y)), fl AS (SELECT family, arg_max(market, (base0, market)) AS flagship FROM sized GROUP BY 1),
day AS (SELECT family, market, d, count(*) AS n, sum(y) AS sy, sum({ll_sql('y', 'p')}) AS nll FROM led JOIN sized USING (family, market) GROUP BY 1, 2, 3),
pk AS (SELECT family, market, d, sum(y) AS ky, count(*) AS kn FROM (SELECT *, row_number() OVER (PARTITION BY family, market, d ORDER BY p DESC, game) AS rn FROM led) WHERE rn <= 10 GROUP BY 1, 2, 3),
si AS (SELECT family, d, row_number() OVER (PARTITION BY family ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY family) AS nd FROM (SELECT DISTINCT family, d FROM led)),
dw AS (SELECT family, rep, {draw_sql('rep', 'i', 'nd', 17)} AS j FROM si, (SELECT unnest(generate_series(1, {REPS})) AS rep)),
w AS (SELECT dw.family, dw.rep, si.d, count(*) AS w FROM dw JOIN si ON dw.family = si.family AND dw.j = si.i GROUP BY 1, 2, 3 UNION ALL SELECT family, 0, d, 1 FROM si),
sm AS (SELECT {fmr}, sum(n * w) AS n, sum(sy * w) AS sy, sum(nll * w) AS nll, sum(ky * w) AS ky, sum(kn * w) AS kn FROM day JOIN pk USING (family, market, d) JOIN w USING (family, d) GROUP BY ALL),
cells0 AS (SELECT {fmr}, (least(floor(p * {GRID}), {GRID - 1}) + 0.5) / {GRID} AS p, sum(y * w) AS pos, sum((1 - y) * w) AS neg FROM led JOIN sized USING (family, market) JOIN w USING (family, d) GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {fmr} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos + neg) OVER (PARTITION BY {fmr} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(pos + neg) OVER (PARTITION BY {fmr}) AS tw FROM cells0),
au AS (SELECT {fmr}, sum(below * pos + 0.5 * pos * neg) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY ALL),
bn AS (SELECT {fmr}, least(CAST(floor(10.0 * cw / tw) AS INT), 9) AS b, sum(pos + neg) AS sw, sum((pos + neg) * p) AS sp, sum(pos) AS sy FROM cu GROUP BY ALL), ec AS (SELECT {fmr}, sum(abs(sp - sy)) / sum(sw) AS ece FROM bn GROUP BY ALL),
cells AS (SELECT {fmr}, {logit_sql('p')} AS z, pos + neg AS n, pos AS sy FROM cells0), {newton_sql('cells', fmr, STEPS)},
q AS (SELECT {fmr}, sm.sy * 1.0 / sm.n AS base, sm.nll / sm.n AS ll, sm.ky * 1.0 / sm.kn AS top, auc, ece, b AS slope FROM sm JOIN au USING ({fmr}) JOIN ec USING ({fmr}) JOIN c{STEPS} USING ({fmr})),
e AS (SELECT *, -(base * ln(base) + (1 - base) * ln(1 - base)) AS ent, (least(top, 1 - 1e-6) / (1 - least(top, 1 - 1e-6))) / (base / (1 - base)) AS orl1 FROM q),
mm AS (SELECT family, rep, avg(100 * (ent - ll) / ent) AS rel, avg(auc) AS auc, avg(ece / (base * (1 - base))) AS ece, avg(slope) AS slope, max(orl1) FILTER (WHERE market = flagship) AS orl, count(*) AS markets FROM e JOIN fl USING (family) GROUP BY 1, 2),
sc AS (SELECT mm.family, rep, markets, n_gate, vs_close, 100 * CASE WHEN vs_close IS NULL THEN ({body}) / 0.9 ELSE {body} + 0.1 * {un('vs_close / 0.02')} END AS score FROM mm LEFT JOIN vs USING (family)),
o AS (SELECT family, max(markets) AS markets, max(score) FILTER (WHERE rep = 0) AS score, quantile_cont(score, 0.10) FILTER (WHERE rep > 0) AS lo, any_value(n_gate) AS n_gate, any_value(vs_close) AS vs FROM sc GROUP BY 1)
SELECT family, markets, round(score, 4) AS score, round(lo, 4) AS score_lo, n_gate, round(vs, 6) AS vs_close, CAST(0 AS BIGINT) AS unsettled,
 CASE WHEN lo >= 72 THEN '1 ELITE' WHEN lo >= 60 THEN '2 STRONG' WHEN lo >= 48 THEN '3 SOLID' WHEN lo >= 44 THEN '4 DECENT' WHEN lo >= 41 THEN '5 LOW CEILING' ELSE '6 AVOID' END AS tier FROM o"""


@query("A45 U5", _sql())
def market_score_tiers(spark, d):
    """Six pillars averaged over a family's markets, the close among them, with the lower bound under day reweighting."""
    led = ledger(spark, d).withColumn("mk", F.concat(F.lit("m"), (F.col("game") % 2).cast("string")))
    prices = M.consensus_many(store(spark, d), ["entity", "market"], "book", {"pc": ("close_over", "close_under", "proportional")}, []).filter("pc IS NOT NULL").withColumnRenamed("market", "mk")
    sc = market_scores(led.drop("mk"), close_edge(led, prices, LEAST_GATE), REPS, 17)
    r = sc.groupBy("family").agg(F.max("markets").alias("markets"), F.max(F.when(F.col("rep") == 0, F.col("score"))).alias("score"), F.percentile(F.when(F.col("rep") > 0, F.col("score")), F.lit(0.10)).alias("score_lo"),
                                 F.first("n_gate").alias("n_gate"), F.first("vs_close").alias("vs_close"), F.sum("unsettled").alias("unsettled"))
    return r.select("family", "markets", F.round("score", 4).alias("score"), F.round("score_lo", 4).alias("score_lo"), "n_gate", F.round("vs_close", 6).alias("vs_close"), "unsettled", P.tier_of("score_lo").alias("tier"))
