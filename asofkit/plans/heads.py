"""Residual heads: boosted context shifts over calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.operators import boosting as B
from asofkit.operators import evaluation as E
from asofkit.operators.asof import asof_join, decayed_panel
from asofkit.operators.windows import ladder_clamp
from asofkit.plans._roles import EV, LED, ledger
from asofkit.registry import query
from asofkit.session import cut_lineage

#: Context of a row: its line, side, distance of the price from even, the entity's form before the day and how much of it there is.
EDGES = {"line": [0.5, 1.5], "home": [0.0], "p_dist": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4], "form": [0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6], "n_form": [1.0, 2.0, 4.0, 8.0, 16.0]}
FIRST = {k: EDGES[k] for k in ("line", "home", "p_dist")}
STEP = B.Boosting(rounds=1, depth=2, rate=0.3, ridge=5.0, min_rows=20)
HEADS = B.Boosting(rounds=4, depth=2, rate=0.4, ridge=5.0, min_rows=100, refresh=4)


def ladders(spark, d, led=None):
    """Three lines per forecast: falling probabilities of one game, and outcomes that lean on the side. ``led``: the ledger, maybe with more columns."""
    led = ledger(spark, d) if led is None else led
    more = [c for c in led.columns if c not in ("game", "d", "family", "entity", "market", "p", "y")]
    # exploded with its line, so that no reader computes p again
    p = lambda line: P.sigmoid(F.log(F.col("p0")) - F.log(1 - F.col("p0")) - 0.6 * (line - 0.5))
    rung = F.inline(F.array(*[F.struct(F.lit(x).alias("line"), p(x).alias("p")) for x in (0.5, 1.5, 2.5)]))
    led = led.select("game", "d", "family", "entity", F.col("p").alias("p0"), (F.col("game") % 2).cast("double").alias("home"), *more)
    led = led.select("game", "d", "family", "entity", "home", *more, rung)
    u = ((F.col("game") * 7919 + 13 + (F.col("line") * 2).cast("long") * 331) % 1000) / 1000.0
    y = (u < 0.1 + 0.6 * F.col("p") + 0.12 * F.col("home")).cast("int")
    return led.select("game", "d", "family", "entity", "line", "home", F.concat("family", F.lit("_"), F.col("line").cast("string")).alias("market"), "p", y.alias("y"), F.abs(F.col("p") - 0.5).alias("p_dist"), *more)


LADDERS = """lad AS (SELECT *, CASE WHEN u < 0.1 + 0.6 * p + 0.12 * home THEN 1 ELSE 0 END AS y, abs(p - 0.5) AS p_dist FROM (SELECT game, d, family, line, game % 2 AS home,
  1.0 / (1.0 + exp(-(ln(p) - ln(1 - p) - 0.6 * (line - 0.5)))) AS p, ((game * 7919 + 13 + CAST(line * 2 AS BIGINT) * 331) % 1000) / 1000.0 AS u FROM led, (SELECT unnest([0.5, 1.5, 2.5]) AS line)))"""


def _bins_sql() -> str:
    return "[" + ", ".join(f"len(list_filter({[float(x) for x in cuts]}, lambda e: e < {name})) + 1" for name, cuts in FIRST.items()) + "]"


def _level_sql(rows: str, name: str) -> str:
    part = lambda x: f"g{x} * g{x} / (h{x} + {STEP.ridge})"
    return f"""{name}h AS (SELECT family, node, f, b, sum(y - q) AS g, sum(q * (1 - q)) AS h, count(*) AS n FROM (SELECT family, node, y, q, unnest(range(0, {len(FIRST)})) AS f, unnest(bins) AS b FROM {rows}) GROUP BY ALL),
{name}c AS (SELECT *, gt - gl AS gr, ht - hl AS hr, nt - nl AS nr FROM (SELECT family, node, f, b, {', '.join(f'sum({c}) OVER (PARTITION BY family, node, f ORDER BY b) AS {c}l, sum({c}) OVER (PARTITION BY family, node, f) AS {c}t' for c in 'ghn')} FROM {name}h)),
{name}g AS (SELECT *, round({part('l')} + {part('r')} - {part('t')}, 9) AS gain FROM {name}c),
{name} AS (SELECT family, node, f, b, gain, gl, hl, gr, hr FROM (SELECT *, row_number() OVER (PARTITION BY family, node ORDER BY gain DESC, f, b) AS rn FROM {name}g WHERE nl >= {STEP.min_rows} AND nr >= {STEP.min_rows} AND gain > 0) WHERE rn = 1)"""


@query("M10", f"""
WITH {EV}, {LED}, {LADDERS}, r AS (SELECT family, 1 AS node, y, 1.0 / (1.0 + exp(-(ln(p) - ln(1 - p)))) AS q, {_bins_sql()} AS bins FROM (SELECT * REPLACE (least(greatest(p, 1e-6), 1 - 1e-6) AS p) FROM lad)),
{_level_sql('r', 'a')}, r2 AS (SELECT r.* REPLACE (CASE WHEN bins[a.f + 1] > a.b THEN 3 ELSE 2 END AS node) FROM r JOIN a USING (family)),
{_level_sql('r2', 'b')}
SELECT family, CAST(node AS INT) AS node, CAST(f AS INT) AS feature, CAST(b AS INT) AS last_bin, round(gain, 6) AS gain, round({STEP.rate} * gl / (hl + {STEP.ridge}), 9) AS left_value, round({STEP.rate} * gr / (hr + {STEP.ridge}), 9) AS right_value FROM (FROM a UNION ALL FROM b)""")
def boosting_first_tree(spark, d):
    """One boosting step with an offset: both levels of the first tree of every family."""
    rows = ladders(spark, d).select("family", B.binned(FIRST).alias("bins"), P.logit("p").alias("z"), "y")
    node, found = F.lit(1), None
    for _ in range(STEP.depth):
        got = B.best_splits(rows, ["family"], node, F.col("bins"), F.col("z"), F.col("y"), STEP).filter("f IS NOT NULL")
        found = got if found is None else found.unionByName(got)
        if found is got:
            rows = rows.join(got.select("family", F.struct("f", "b").alias("root")), "family")
            node = F.when(F.get("bins", F.col("root.f")) > F.col("root.b"), 3).otherwise(2)
    value = lambda side: F.round(STEP.rate * F.col(f"g{side}") / (F.col(f"h{side}") + STEP.ridge), 9)
    return found.select("family", "node", F.col("f").alias("feature"), F.col("b").alias("last_bin"), F.round("gain", 6).alias("gain"), value("l").alias("left_value"), value("r").alias("right_value"))


@query("M10 W14")
def residual_heads(spark, d):
    """Boosted context shifts per family with logit(p_cal) as offset, kept on held-out gain alone; ladders stay in order afterwards."""
    led = ladders(spark, d)
    maps = E.platt_maps(led, ["family"], 500), E.platt_maps(led, ["family", "market"], 3000)
    # the form is of an entity and a day, so it joins the forecasts before their lines multiply them
    daily = led.groupBy("entity", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    formed = asof_join(ledger(spark, d), decayed_panel(daily, ["entity"], ["n", "hits"], 7.0), ["entity"], ["n_d", "hits_d"], half_life=7.0)
    formed = formed.withColumn("form", F.col("hits_d") / F.col("n_d")).withColumn("n_form", F.col("n_d")).drop("n_d", "hits_d")
    cal = E.calibrated(ladders(spark, d, formed), *maps, "family", "market")
    cal = cal.withColumn("p_cal", P.clip("p_cal", 1e-6, 1 - 1e-6)).withColumn("p_dist", F.abs(F.col("p_cal") - 0.5))
    # written once: the day counts, the fit and the serving read it
    cal = cut_lineage(cal.select("game", "d", "family", "y", "p_cal", *EDGES))
    heads, report = B.residual_heads(cal, "family", "d", "p_cal", "y", EDGES, HEADS, least=300)
    served = B.apply_heads(cal.select("game", "family", "line", "y", "p_cal", B.binned(EDGES).alias("bins")), heads, ["family"], "bins", "p_cal", HEADS.depth).drop("bins")
    served = ladder_clamp(served, ["family", "game"], "line", "p_head", "p_served")
    out = served.groupBy("family").agg(F.count_if(F.col("p_served") < F.col("p_head")).alias("clamped"), F.avg(P.log_loss("y", "p_cal")).alias("ll_cal_all"), F.avg(P.log_loss("y", "p_served")).alias("ll_served_all"))
    r6 = lambda c: F.round(c, 6).alias(c)
    return report.join(out, "family").select("family", "n", "n_holdout", "best_iter", r6("ll_base"), r6("ll_head"), r6("gain"), r6("max_adj"), "status", "clamped", r6("ll_cal_all"), r6("ll_served_all"))
