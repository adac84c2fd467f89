"""Models fitted by grouped Newton steps: removal hazard, advance tilt, attempt states."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.operators import evaluation as E
from asofkit.operators import glm as G
from asofkit.plans._roles import LABELS, PA, appearances
from asofkit.plans.aggregates import CAUSE, RET30, RISK, risk_rows
from asofkit.registry import query
from asofkit.session import cut_lineage


def glm_sql(cells: str, key: str, terms: list[str], steps: int) -> str:
    """CTEs up to ``fit`` (key, term, beta, se, z): Newton steps, each solved by elimination on the augmented matrix."""
    k = len(terms) + 1
    x = ["1.0", *terms]
    mu = "(1.0 / (1.0 + exp(-(" + " + ".join(f"b{i} * {x[i]}" for i in range(k)) + "))))"
    row = lambda i: [f"h{i}_{j}" for j in range(k)] + [f"g{i}"] + [f"v{i}_{j}" for j in range(k)]
    betas = ", ".join(f"b{i}" for i in range(k))
    out = [f"n0 AS (SELECT {key}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM {cells} GROUP BY 1)"]
    for s in range(steps):
        sums = [f"sum(n * m * (1 - m) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(k) for j in range(k)] + [f"sum((sy - n * m) * {x[i]}) AS g{i}" for i in range(k)]
        eye = [f"{float(i == j)}::DOUBLE AS v{i}_{j}" for i in range(k) for j in range(k)]
        out.append(f"s{s} AS (SELECT {key}, {betas}, {', '.join(sums)}, {', '.join(eye)} FROM (SELECT c.*, n{s}.* EXCLUDE ({key}), {mu} AS m FROM {cells} c JOIN n{s} ON c.{key} = n{s}.{key}) GROUP BY {key}, {betas})")
        last = f"s{s}"
        for p in range(k):
            new = [f"{a} / h{p}_{p} AS {a}" if i == p else f"{a} - h{i}_{p} / h{p}_{p} * {b} AS {a}" for i in range(k) for a, b in zip(row(i), row(p), strict=True)]
            out.append(f"e{s}_{p} AS MATERIALIZED (SELECT {key}, {betas}, {', '.join(new)} FROM {last})")
            last = f"e{s}_{p}"
        out.append(f"n{s + 1} AS (SELECT {key}, {', '.join(f'b{i} + g{i} AS b{i}' for i in range(k))} FROM {last})")
    names = ["intercept", *terms]
    small = "greatest(" + ", ".join(f"abs(e.g{i})" for i in range(k)) + ") < 1e-6"  # keys whose last step has settled
    pick = " UNION ALL ".join(f"SELECT f.{key}, '{t}' AS term, f.b{i} AS beta, sqrt(e.v{i}_{i}) AS se FROM n{steps - 1} f JOIN e{steps - 1}_{k - 1} e ON f.{key} = e.{key} WHERE {small}" for i, t in enumerate(names))
    return ",\n".join(out) + f",\nfit AS (SELECT {key}, term, beta, se, beta / se AS z FROM ({pick}))"


def _shown(fit, *keep):
    return fit.select(*keep, "term", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), F.round("z", 4).alias("z"))


SHOWN = "term, round(beta, 5) AS beta, round(se, 5) AS se, round(z, 4) AS z FROM fit"
CALIBRATE = 1999
CAUSES = ("hook", "injury")
HAZARD = {t: t for t in ("ramp", "short", "il_ret30", "seq")}


def _cause_cells(rows):
    """Rows folded to their covariates, once per cause: an exit of one cause is a row at risk of the other."""
    cells = rows.groupBy("season", *HAZARD).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("cause") == c).alias(c) for c in CAUSES])
    return cells.unpivot(["season", *HAZARD, "n"], list(CAUSES), "cause", "sy")


_CELLS = f"""{RISK}, rr AS (SELECT h.season, ramp, short, {RET30} AS il_ret30, h.seq, {CAUSE} AS cause FROM h JOIN bw ON h.pitcher = bw.pitcher AND h.d = bw.d),
cc AS (SELECT k.cause, ramp, short, il_ret30, seq, count(*) AS n, count(*) FILTER (WHERE rr.cause = k.cause) AS sy FROM rr, (SELECT unnest(['hook', 'injury']) AS cause) k WHERE season < {CALIBRATE} GROUP BY 1, 2, 3, 4, 5)"""


@query("M12", f"WITH {_CELLS}, {glm_sql('cc', 'cause', list(HAZARD), 14)} SELECT cause, {SHOWN}")
def removal_hazard_fit(spark, d):
    """Cause-specific discrete-time hazards on the risk rows before the calibration season."""
    cells = _cause_cells(risk_rows(spark, d).filter(F.col("season") < CALIBRATE))
    return _shown(G.fit_logistic(cells, "cause", HAZARD, "n", "sy").filter("settled"), "cause")


@query("M12 M5")
def removal_hazard(spark, d):
    """Hazards of both causes, their sum calibrated on one season and scored on those after it, against a constant rate."""
    cells = cut_lineage(_cause_cells(risk_rows(spark, d)))  # few cells; the fit and the scores read them
    fit = G.fit_logistic(cells.filter(F.col("season") < CALIBRATE), "cause", HAZARD, "n", "sy")
    scored = G.score(cells, G.coefficients(fit, "cause", list(HAZARD)), "cause", HAZARD, "p")
    wide = scored.groupBy("season", *HAZARD).agg(F.max("n").alias("n"), F.sum("sy").alias("sy"), *[F.max(F.when(F.col("cause") == c, F.col("p"))).alias(f"p_{c}") for c in CAUSES])
    wide = wide.withColumn("p", P.clip(F.col("p_hook") + F.col("p_injury"), 1e-6, 1 - 1e-6)).withColumn("one", F.lit("all"))
    wide = cut_lineage(wide)  # a row per cell of covariates, read three times
    cal = wide.filter(F.col("season") == CALIBRATE).groupBy("one", P.logit("p").alias("z")).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    size = cal.groupBy("one").agg(F.sum("n").alias("cal_n"), F.sum("sy").alias("cal_sy"))
    # the rule of the maps: rows enough, both outcomes and a positive slope, else identity
    maps = E.logistic_fits(cal, ["one"], "z", "n", "sy").join(size, "one").filter("cal_n >= 500 AND cal_sy > 0 AND cal_sy < cal_n AND b > 0").select("one", "a", "b")
    late = wide.filter(F.col("season") > CALIBRATE).join(maps, "one", "left")
    late = late.withColumn("p_cal", F.when(F.col("a").isNull(), F.col("p")).otherwise(P.platt("p", "a", "b")))
    base = wide.filter(F.col("season") < CALIBRATE).agg(F.sum("sy") / F.sum("n")).scalar()
    late = late.withColumn("base", base)
    loss = lambda p: F.sum(F.col("sy") * P.log_loss(F.lit(1), p) + (F.col("n") - F.col("sy")) * P.log_loss(F.lit(0), p)) / F.sum("n")
    r = late.groupBy("season").agg(F.sum("n").alias("n"), F.sum("sy").alias("removed"), (F.sum(F.col("n") * F.col("p_cal"))).alias("expected"), F.max(F.col("p_hook") + F.col("p_injury")).alias("max_sum"), loss("p_cal").alias("ll"), loss("base").alias("ll_base"))
    return r.select("season", "n", "removed", F.round("expected", 3).alias("expected"), F.round("max_sum", 6).alias("max_sum"), F.round("ll", 6).alias("ll"), F.round("ll_base", 6).alias("ll_base"), (F.col("max_sum") <= 1).alias("sums_hold"))


TILT = {"prior": "prior", "late": "late", "prior_late": "prior * late", "mid": "mid"}


@query("M13 J2", f"""WITH {PA}, sea AS (SELECT pitcher, season, count(*) FILTER (WHERE label = 'cR') * 1.0 / count(*) AS prior FROM pa GROUP BY 1, 2),
t AS (SELECT 'all' AS k, coalesce(s.prior, 0.33) * 10 AS prior, (seq >= 5)::INT AS late, (seq BETWEEN 3 AND 4)::INT AS mid, status FROM pa LEFT JOIN sea s ON s.pitcher = pa.pitcher AND s.season + 1 = pa.season),
tc AS (SELECT k, prior, late, prior * late AS prior_late, mid, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS sy FROM t GROUP BY 1, 2, 3, 4, 5), {glm_sql('tc', 'k', list(TILT), 8)} SELECT {SHOWN}""")
def advance_tilt(spark, d):
    """A prior-season trait, its interaction with the situation and controls: estimates, standard errors and z values."""
    from asofkit.operators.shrink import class_counts, prior_season

    pa = appearances(spark, d)
    rate = class_counts(pa, ["pitcher", "season"], "label", LABELS).select("pitcher", "season", (F.col("cR") / F.col("n")).alias("prior"))
    r = prior_season(pa, rate, ["pitcher"], "season", "season", ["prior"], {"prior": 0.33})
    flag = lambda c: F.expr(c).cast("int")
    cells = r.groupBy(F.lit("all").alias("k"), (F.col("prior") * 10).alias("prior"), flag("seq >= 5").alias("late"), flag("seq BETWEEN 3 AND 4").alias("mid")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "O").alias("sy"))
    return _shown(G.fit_logistic(cells, "k", TILT, "n", "sy"))


STATES = {"outs": "outs", "outs1": "outs1", "close": "close"}


@query("M11", f"""WITH {PA}, t AS (SELECT 'attempt' AS k, season, seq % 3 AS outs, (seq % 3 = 1)::INT AS outs1, (status = 'O')::INT AS close, (price > 50000)::INT AS y FROM pa),
tc AS (SELECT k, outs, outs1, close, count(*) AS n, sum(y) AS sy FROM t WHERE season < 2000 GROUP BY 1, 2, 3, 4), {glm_sql('tc', 'k', list(STATES), 8)},
w AS (SELECT max(beta) FILTER (WHERE term = 'intercept') AS b0, max(beta) FILTER (WHERE term = 'outs') AS bo, max(beta) FILTER (WHERE term = 'outs1') AS b1, max(beta) FILTER (WHERE term = 'close') AS bc FROM fit),
era AS (SELECT CASE WHEN season < 1997 THEN 'before' ELSE 'after' END AS era, avg(y) AS truth, avg(1.0 / (1.0 + exp(-(b0 + bo * outs + b1 * outs1 + bc * close)))) AS mean FROM t, w WHERE season < 2000 GROUP BY 1)
SELECT name, round(value, 5) AS value FROM (SELECT 'outs0' AS name, -bo - b1 AS value FROM w UNION ALL SELECT 'outs2', bo - b1 FROM w UNION ALL SELECT 'far', -bc FROM w UNION ALL SELECT 'shift_' || era, ln(truth / (1 - truth)) - ln(mean / (1 - mean)) FROM era)""")
def attempt_state_deltas(spark, d):
    """Logit deltas of the states off the serving baseline (one out, close), and the shift of each era's level to its truth."""
    flag = lambda c: F.expr(c).cast("int")
    r = appearances(spark, d).filter("season < 2000").select(F.lit("attempt").alias("k"), F.expr("CASE WHEN season < 1997 THEN 'before' ELSE 'after' END").alias("era"), (F.col("seq") % 3).alias("outs"), flag("seq % 3 = 1").alias("outs1"), flag("status = 'O'").alias("close"), flag("price > 50000").alias("y"))
    cells = cut_lineage(r.groupBy("k", "era", *STATES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")))  # few cells, read twice
    fit = G.fit_logistic(cells.groupBy("k", *STATES).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy")), "k", STATES, "n", "sy")
    at = lambda t: F.max(F.when(F.col("term") == t, F.col("beta")))
    w = fit.agg((-at("outs") - at("outs1")).alias("outs0"), (at("outs") - at("outs1")).alias("outs2"), (-at("close")).alias("far"))
    eras = G.score(cells, G.coefficients(fit, "k", list(STATES)), "k", STATES, "p").groupBy("era").agg((F.sum("sy") / F.sum("n")).alias("truth"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean"))
    shift = eras.select(F.concat(F.lit("shift_"), F.col("era")).alias("name"), (P.logit("truth") - P.logit("mean")).alias("value"))
    return w.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in w.columns]), F.array(*w.columns))).alias("name", "value")).unionByName(shift).select("name", F.round("value", 5).alias("value"))
