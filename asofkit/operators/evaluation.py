"""Forecast evaluation over a graded ledger (date, family, market, p, y).

Ledger rows are folded to per-day or per-value sufficient sums first; resampling,
ranking and calibration then work on those small frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.functions.hashing import draw
from asofkit.operators.scan import Running, exact_quantiles, null_safe_join, ordered_scan, top_k
from asofkit.session import cut_lineage


# A fine fixed grid: even if a third of the values crowd into one percent of the range, no chunk is large,
# and the second level of a scan still sees at most this many rows per key.
PROBABILITY_CHUNKS = 16384


def probability_chunk(p: str) -> Column:
    return F.floor(F.col(p) * PROBABILITY_CHUNKS)


def skill_report(led: DataFrame, family: str = "family", market: str = "market") -> DataFrame:
    """Log loss, Brier, base-rate loss and gain for family, family x market and ALL in one pass."""
    agg = led.groupingSets([[], [family], [family, market]], family, market).agg(
        F.count(F.lit(1)).alias("n"), F.avg(P.log_loss("y", "p")).alias("ll"), F.avg(P.brier("y", "p")).alias("brier"),
        F.avg("y").alias("base"), F.avg("p").alias("mean_p"), F.grouping(family).alias("__gf"), F.grouping(market).alias("__gm"))
    ent = P.entropy2(F.col("base"))
    grain = F.when(F.col("__gf") == 1, "ALL").when(F.col("__gm") == 1, "family").otherwise("market")
    return agg.select(grain.alias("grain"), F.coalesce(family, F.lit("ALL")).alias("family"), F.coalesce(market, F.lit("ALL")).alias("market"),
                      "n", "ll", "brier", "base", "mean_p", ent.alias("base_ll"), (ent - F.col("ll")).alias("gain"))


def value_counts(led: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Positives and negatives per distinct probability: the sufficient form for rank metrics."""
    return led.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def auc(counts: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Rank-sum AUC with ties from (possibly weighted) pos/neg per value."""
    s = ordered_scan(counts, keys, [F.col(p)], probability_chunk(p), [Running("__below", F.col("neg"), inclusive=False)])
    return s.groupBy(*keys).agg(
        (F.sum(F.col("__below") * F.col("pos") + 0.5 * F.col("pos") * F.col("neg")) /
         F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))


def ece(led: DataFrame, keys: Sequence[str], bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Calibration error over equal-count bins; repeated edges are merged."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(led, keys, p, probs, probability_chunk(p)).groupBy(*keys).agg(
        F.array_sort(F.collect_set("quantile")).alias("__e"))
    cells = null_safe_join(led.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy")), edges, list(keys))
    # an edge at the smallest value only repeats the lower bound, so its bin merges with the next
    lo = led.groupBy(*keys).agg(F.min(p).alias("__lo"))
    cells = null_safe_join(cells, lo, list(keys))
    b = F.size(F.filter("__e", lambda e: (e < F.col(p)) & (e > F.col("__lo"))))
    g = cells.withColumn("__b", b).groupBy(*keys, "__b").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col(p)).alias("sp"), F.sum("sy").alias("sy"))
    return g.groupBy(*keys).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def weighted_ece(counts: DataFrame, keys: Sequence[str], bins: int = 10, p: str = "p") -> DataFrame:
    """Calibration error over bins of equal weight, from weighted pos/neg per value."""
    c = counts.withColumn("__w", F.col("pos") + F.col("neg"))
    s = ordered_scan(c, keys, [F.col(p)], probability_chunk(p), [Running("__cw", F.col("__w"))])
    tot = c.groupBy(*keys).agg(F.sum("__w").alias("__t"))
    s = null_safe_join(s, tot, list(keys)).filter("__w > 0")
    b = F.least(F.floor(bins * F.col("__cw") / F.col("__t")), F.lit(bins - 1))
    g = s.withColumn("__b", b).groupBy(*keys, "__b").agg(
        F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col(p)).alias("sp"), F.sum("pos").alias("sy"))
    return g.groupBy(*keys).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("w")).alias("ece"))


# Ranges of a probability whose values, replicates and running sums stay in one task, and the tasks they are dealt to. The
# number is given, since the values are few bytes before the replicates multiply them and would be put into one task.
RESAMPLE_CHUNKS = RESAMPLE_PARTS = 128


def resampled_cells(counts: DataFrame, weights: DataFrame, group: Sequence[str], date: str, p: str = "p") -> DataFrame:
    """Weighted pos and neg of every (group, rep, value), from ``counts`` (group, date, value, pos, neg) and ``weights`` (group, rep,
    date, w); ``below`` (negatives under the value) and ``upto`` (all up to it) count within the value's ``chunk``. Written once.

    Values are placed by range before the replicates multiply them: neither the products nor their running sums are shuffled.
    """
    group = list(group)
    at = counts.withColumn("chunk", F.floor(F.col(p) * RESAMPLE_CHUNKS)).repartition(RESAMPLE_PARTS, *group, "chunk").join(weights, [*group, date])
    ws = lambda c: F.sum(F.col(c) * F.col("w")).alias(c)
    cells = at.groupBy(*group, "chunk", "rep", p).agg(ws("pos"), ws("neg")).withColumn("n", F.col("pos") + F.col("neg"))
    w = Window.partitionBy(*group, "chunk", "rep").orderBy(p)
    below = F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut_lineage(cells.select(*group, "rep", "chunk", p, P.logit(p).alias("z"), "pos", "neg", "n", below.alias("below"), upto.alias("upto")))


def auc_and_ece(cells: DataFrame, keys: Sequence[str], bins: int = 10, p: str = "p") -> DataFrame:
    """``auc`` and ``weighted_ece`` of ``resampled_cells``: one row per (keys, chunk) carries what came before the chunk."""
    keys = list(keys)
    area = F.sum(F.col("below") * F.col("pos") + 0.5 * F.col("pos") * F.col("neg"))
    part = cells.groupBy(*keys, "chunk").agg(area.alias("area"), *[F.sum(c).alias(c) for c in ("pos", "neg", "n")])
    w = Window.partitionBy(*keys)
    before = w.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    part = cut_lineage(part.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("neg", "n")], F.sum("n").over(w).alias("n_all")))
    ranks = part.groupBy(*keys).agg(
        (F.sum(F.col("area") + F.col("neg_before") * F.col("pos")) / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))
    b = F.least(F.floor(bins * (F.col("n_before") + F.col("upto")) / F.col("n_all")), F.lit(bins - 1))
    at = cells.filter("n > 0").join(part.select(*keys, "chunk", "n_before", "n_all"), [*keys, "chunk"])
    g = at.groupBy(*keys, b.alias("__b")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col(p)).alias("sp"), F.sum("pos").alias("sy"))
    return ranks.join(g.groupBy(*keys).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece")), keys)


def reliability(led: DataFrame, keys: Sequence[str], lo: float = 0.5, width: float = 0.05, p: str = "p") -> DataFrame:
    """Stated versus hit in half-open bands of fixed width from ``lo`` up."""
    b = F.floor((F.col(p) - lo) / width)
    r = led.filter(F.col(p) >= lo).groupBy(*keys, b.cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("stated"), F.avg("y").alias("hit"))
    return r.withColumn("gap", F.col("hit") - F.col("stated"))


# Cut points of the model-minus-close buckets.
EDGE_CUTS = (-0.10, -0.05, -0.03, 0.03, 0.05, 0.10)


def edge_bucket(edge: Column) -> Column:
    """Right-closed bucket number 0..6 of an edge."""
    return sum(((edge > c).cast("int") for c in EDGE_CUTS), F.lit(0))


def slate_index(daily: DataFrame, group: Sequence[str], date: str) -> DataFrame:
    """Position of each date within its group (input one row per group and date)."""
    w = Window.partitionBy(*group).orderBy(date)
    idx = daily.select(*group, date).distinct()
    n = idx.groupBy(*group).agg(F.count(F.lit(1)).alias("n_dates")) if group else None
    idx = idx.withColumn("i", F.row_number().over(w) - 1)
    return null_safe_join(idx, n, list(group)) if group else idx.withColumn("n_dates", daily.select(F.countDistinct(date)).scalar())


def day_weights(index: DataFrame, group: Sequence[str], date: str, reps: int, seed: int) -> DataFrame:
    """How often each date is drawn in each replicate (deterministic draws with replacement)."""
    d = index.select(*group, "i", "n_dates", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    d = d.groupBy(*group, "rep", draw(F.col("rep"), F.col("i"), F.col("n_dates"), seed).alias("i")).agg(F.count(F.lit(1)).alias("w"))
    return d.join(index.select(*group, "i", date), [*group, "i"]).drop("i")


def block_bootstrap(
    daily: DataFrame, group: Sequence[str], date: str, num: str, den: str, reps: int = 500, seed: int = 7,
    shared: bool = False,
) -> DataFrame:
    """Per replicate and group: sum of drawn numerators over sum of drawn denominators.

    ``daily`` has one row per group and date; it is materialised once, since the draws and the
    sums both read it. ``shared`` draws one set of dates for all groups.
    """
    daily = cut_lineage(daily.select(*group, date, num, den))
    w = day_weights(slate_index(daily, [] if shared else group, date), [] if shared else list(group), date, reps, seed)
    j = daily.join(w, [date] if shared else [*group, date])
    return j.groupBy(*group, "rep").agg(
        (F.sum(F.col(num) * F.col("w")) / F.nullif(F.sum(F.col(den) * F.col("w")).cast("double"), F.lit(0.0))).alias("stat"))


def bootstrap_summary(boot: DataFrame, group: Sequence[str]) -> DataFrame:
    """5th and 95th percentile with one- and two-sided p-values; replicates per group are fixed in number."""
    le, ge = F.avg((F.col("stat") <= 0).cast("double")), F.avg((F.col("stat") >= 0).cast("double"))
    return boot.groupBy(*group).agg(
        F.percentile("stat", F.lit(0.05)).alias("ci_lo"), F.percentile("stat", F.lit(0.95)).alias("ci_hi"), le.alias("p_one"),
        F.least(2.0 * F.least(le, ge), F.lit(1.0)).alias("p_two"))


def bh_adjust(rep: DataFrame, p: str, tie: str, out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg over the rows of a report (one row per family)."""
    up = Window.orderBy(F.col(p).asc(), F.col(tie).asc())
    down = Window.orderBy(F.desc("__rk")).rowsBetween(Window.unboundedPreceding, 0)
    m = rep.agg(F.count(F.lit(1))).scalar()
    r = rep.withColumn("__rk", F.row_number().over(up)).withColumn("__q", F.col(p) * m / F.col("__rk"))
    return r.withColumn(out, F.least(F.min("__q").over(down), F.lit(1.0))).drop("__rk", "__q")


def pair_ledgers(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows on both sides with equal outcomes; loss difference d > 0 means b is better."""
    one = lambda df: df.groupBy(*key).agg(F.min_by(F.struct("d", "family", "p", "y"), F.struct("d", "p")).alias("v"))
    j = one(a).withColumnRenamed("v", "va").join(one(b).withColumnRenamed("v", "vb"), list(key))
    j = j.filter(F.col("va.y") == F.col("vb.y"))
    la, lb = P.log_loss("va.y", "va.p"), P.log_loss("vb.y", "vb.p")
    return j.select(*key, F.col("va.d").alias("d"), F.col("va.family").alias("family"), F.col("va.y").alias("y"),
                    F.col("va.p").alias("p_a"), F.col("vb.p").alias("p_b"), la.alias("ll_a"), lb.alias("ll_b"), (la - lb).alias("delta"))


def ab_report(pairs: DataFrame, reps: int = 500, alpha: float = 0.05, min_n: int = 800, seed: int = 7) -> DataFrame:
    """Per family and ALL: mean loss difference, date-block interval, BH p and verdict."""
    day = pairs.groupBy("family", "d").agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("ll_a").alias("sa"), F.sum("ll_b").alias("sb"))
    # the big join of the two ledgers runs once; everything below reads family-day sums
    day = cut_lineage(day)
    day = day.unionByName(day.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("s", "n", "sa", "sb")]).withColumn("family", F.lit("ALL")))
    tot = day.groupBy("family").agg(F.sum("n").alias("n"), (F.sum("sa") / F.sum("n")).alias("ll_a"), (F.sum("sb") / F.sum("n")).alias("ll_b"),
                                    (F.sum("s") / F.sum("n")).alias("delta"))
    ci = bootstrap_summary(block_bootstrap(day, ["family"], "d", "s", "n", reps, seed), ["family"])
    # one row per family; read by the adjustment, its count and the report
    rep = cut_lineage(tot.join(ci, "family").withColumn("p_raw", F.col("p_two")))
    fam = bh_adjust(rep.filter("family <> 'ALL'"), "p_raw", "family").select("family", "p_bh")
    rep = rep.join(fam, "family", "left")
    verdict = (F.when(F.col("family") == "ALL", "").when(F.col("n") < min_n, "INSUFFICIENT n")
               .when((F.col("p_bh") < alpha) & (F.col("ci_lo") > 0), "B BETTER")
               .when((F.col("p_bh") < alpha) & (F.col("ci_hi") < 0), "A BETTER").otherwise("TIE"))
    return rep.select("family", "n", "ll_a", "ll_b", "delta", "ci_lo", "ci_hi", "p_raw", "p_bh", verdict.alias("verdict"))


DEPTHS = 15


def goal_board(led: DataFrame, keys: Sequence[str], date: str, tie: Sequence[Column], reps: int = 300, gate: float = 1.5,
               min_slates: int = 8, seed: int = 7) -> DataFrame:
    """Top-of-ranking board: hit rates at depth 1/3/10, cells above 50%, and the deepest depth whose
    bootstrapped odds-ratio lift over the base stays above ``gate``."""
    keys = list(keys)
    k = [*keys, date]
    tops = top_k(led, k, [F.desc("p"), *tie], DEPTHS)
    at = lambda c, n: F.avg(F.when(F.col("rn") <= n, F.col(c)))
    hits = tops.groupBy(*keys).agg(at("y", 1).alias("t1_hit"), at("y", 3).alias("t3_hit"), at("p", 10).alias("t10_stated"), at("y", 10).alias("t10_hit"))
    hi = F.col("p") > 0.5
    base = led.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base"), F.count_if(hi).alias("hi_n"),
                                  F.avg(F.when(hi, F.col("p"))).alias("hi_stated"), F.avg(F.when(hi, F.col("y"))).alias("hi_hit"))
    # at most DEPTHS rows per slate here, so the arrays are bounded; thin slates saturate at their size
    arr = F.transform(F.array_sort(F.collect_list(F.struct("rn", "y"))), lambda s: s["y"].cast("double"))
    slate = tops.groupBy(*k).agg(arr.alias("ys")).join(led.groupBy(*k).agg(F.sum("y").alias("ht"), F.count(F.lit(1)).alias("ct")), k)
    h = lambda n: F.aggregate(F.slice("ys", 1, n), F.lit(0.0), lambda a, x: a + x)
    c = lambda n: F.least(F.size("ys"), F.lit(n)).cast("double")
    slate = cut_lineage(slate.select(*k, "ht", "ct", *[h(n).alias(f"h{n}") for n in range(1, DEPTHS + 1)], *[c(n).alias(f"c{n}") for n in range(1, DEPTHS + 1)]))
    idx = slate_index(slate, keys, date)
    w = day_weights(idx.filter(F.col("n_dates") >= min_slates), keys, date, reps, seed)
    ws = lambda x: F.sum(F.col(x) * F.col("w"))
    b = slate.join(w, k).groupBy(*keys, "rep").agg(ws("ht").alias("ht"), ws("ct").alias("ct"), *[
        F.struct(ws(f"h{n}").alias("h"), ws(f"c{n}").alias("c")).alias(f"s{n}") for n in range(1, DEPTHS + 1)])
    odds = lambda x: P.clip(x, 1e-6, 1 - 1e-6) / (1 - P.clip(x, 1e-6, 1 - 1e-6))
    long = b.select(*keys, "rep", odds(F.col("ht") / F.greatest("ct", F.lit(1.0))).alias("bo"), F.posexplode(F.array(*[f"s{n}" for n in range(1, DEPTHS + 1)])).alias("pos", "s"))
    lift = long.groupBy(*keys, "pos").agg(F.percentile(odds(F.col("s.h") / F.greatest("s.c", F.lit(1.0))) / F.col("bo"), F.lit(0.10)).alias("lcb"))
    depth = lift.filter(F.col("lcb") >= gate).groupBy(*keys).agg((F.max("pos") + 1).alias("depth"))
    out = base.join(hits, keys).join(auc(value_counts(led, keys), keys), keys).join(depth, keys, "left")
    return out.select(*keys, "n", "base", "auc", "t1_hit", "t3_hit", "t10_stated", "t10_hit", (F.col("t10_hit") - F.col("t10_stated")).alias("t10_gap"),
                      "hi_n", "hi_stated", "hi_hit", F.coalesce("depth", F.lit(0)).cast("int").alias("trust_depth"))


TOL, LIMIT = 1e-10, 50


def settled(start: DataFrame, step, tol: float = TOL, limit: int = LIMIT) -> DataFrame:
    """Repeat ``step`` (table of keys, values and ``move``, the last step's size) until every key moves less than ``tol``.

    Each table is small (a row per key), written, and joined back to the cells by its true size,
    so the cells stay where they are and a hot key's sums are partial in every task. Keys still
    moving after ``limit`` steps keep their ``move`` for the caller to see.
    """
    now = cut_lineage(start)
    for _ in range(limit):
        now = cut_lineage(step(now))
        worst = now.agg(F.max("move")).first()[0]
        if worst is None or worst < tol:
            break
    return now


def logistic_fits(cells: DataFrame, keys: Sequence[str], z: str, n: str, sy: str, a0: float = 0.0, b0: float = 1.0,
                  start: DataFrame | None = None, keep_unsettled: bool = False, written: bool = False) -> DataFrame:
    """Two-parameter logistic fit per key by Newton steps; each step is one grouped aggregate of five sums
    for all keys at once. ``cells`` is pre-folded: rows (keys, z) with weight n and positives sy.
    Keys whose steps do not settle (separable data) are left out, or kept with their last values and ``settled`` false.
    ``written``: the cells are a table already.
    """
    keys = list(keys)
    cells = cells if written else cut_lineage(cells)
    coef = start if start is not None else cells.groupBy(*keys).agg(F.lit(a0).alias("a"), F.lit(b0).alias("b"))

    def step(coef: DataFrame) -> DataFrame:
        mu = P.sigmoid(F.col("a") + F.col("b") * F.col(z))
        wd = F.col(n) * mu * (1 - mu)
        r = F.col(sy) - F.col(n) * mu
        s = cells.join(coef.drop("move"), keys).groupBy(*keys).agg(
            F.first("a").alias("a"), F.first("b").alias("b"), F.sum(wd).alias("h0"), F.sum(wd * F.col(z)).alias("h1"),
            F.sum(wd * F.col(z) * F.col(z)).alias("h2"), F.sum(r).alias("g0"), F.sum(r * F.col(z)).alias("g1"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        ok = F.abs(det) >= 1e-12
        da = F.when(ok, (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).otherwise(0.0)
        db = F.when(ok, (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).otherwise(0.0)
        return s.select(*keys, (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("move"))

    fit = settled(coef.withColumn("move", F.lit(float("inf"))), step)
    ok = F.coalesce(F.col("move") < 1e-6, F.lit(False))
    return fit.withColumn("settled", ok).drop("move") if keep_unsettled else fit.filter(ok).drop("move")


def platt_maps(led: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    """Usable maps only: enough rows, both classes present, positive slope. Others mean identity."""
    keys = list(keys)
    cells = cut_lineage(led.groupBy(*keys, P.logit("p").alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")))
    size = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    fit = logistic_fits(cells, keys, "z", "n", "sy", written=True)
    return fit.join(size, keys).filter((F.col("n") >= min_n) & (F.col("sy") > 0) & (F.col("sy") < F.col("n")) & (F.col("b") > 0)).select(
        *keys, "n", "a", "b")


def calibrated(led: DataFrame, family_maps: DataFrame, line_maps: DataFrame, family: str, line: str) -> DataFrame:
    """Line map first, then family map, then the raw probability."""
    f = family_maps.select(family, F.struct("a", "b").alias("__f"))
    m = line_maps.select(family, line, F.struct("a", "b").alias("__l"))
    j = led.join(f, family, "left").join(m, [family, line], "left")
    ab = F.coalesce("__l", "__f")
    return j.withColumn("p_cal", F.when(ab.isNull(), F.col("p")).otherwise(P.platt("p", ab["a"], ab["b"]))).withColumn(
        "cal_via", F.when(F.col("__l").isNotNull(), "line").when(F.col("__f").isNotNull(), "family").otherwise("identity")).drop("__f", "__l")


def crossfit_calibration(led: DataFrame, family: str, date: str, folds: int = 5, min_train: int = 300) -> DataFrame:
    """Day-block cross-fit map: each fold uses the map fitted on the other days of its family.

    All (family, fold) fits run together. Folds come from the position of the day, so a fold
    table has one row per day.
    """
    idx = slate_index(led, [family], date).select(family, date, (F.col("i") % folds).alias("fold"))
    j = led.join(idx, [family, date]).withColumn("p", P.clip("p", 1e-4, 1 - 1e-4))
    day = j.groupBy(family, "fold", P.logit("p", 1e-4).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"))
    # train cells of fold f: the cells of every other fold of the family (folds - 1 copies of the folded data)
    train = day.withColumn("t", F.explode(F.array_remove(F.array(*[F.lit(i) for i in range(folds)]), F.col("fold")))).groupBy(
        family, F.col("t").cast("long").alias("fold"), "z").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    j = j.withColumn("fold", F.col("fold").cast("long"))
    size = train.groupBy(family, "fold").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    fit = logistic_fits(train, [family, "fold"], "z", "n", "sy").join(size, [family, "fold"]).filter(
        (F.col("n") >= min_train) & (F.col("sy") > 0) & (F.col("sy") < F.col("n")) & (F.col("b") > 0)).select(family, "fold", "a", "b")
    out = j.join(fit, [family, "fold"], "left")
    p = F.when(F.col("a").isNull(), F.col("p")).otherwise(P.platt("p", "a", "b"))
    return out.withColumn("p_cal", P.clip(p, 1e-4, 1 - 1e-4)).drop("a", "b")


def offset_logistic(cells: DataFrame, keys: Sequence[str], offset: Column, x: Column, n: str, sy: str) -> DataFrame:
    """One slope with a fixed offset per key: estimate, standard error and z value; Newton steps until they settle."""
    keys = list(keys)
    c = cut_lineage(cells.select(*keys, offset.alias("__o"), x.alias("__x"), n, sy))
    beta = c.groupBy(*keys).agg(F.lit(0.0).alias("beta"))

    def sums(beta: DataFrame) -> DataFrame:
        mu = P.sigmoid(F.col("__o") + F.col("beta") * F.col("__x"))
        return c.join(beta.select(*keys, "beta"), keys).groupBy(*keys).agg(
            F.first("beta").alias("beta"), F.sum(F.col("__x") * (F.col(sy) - F.col(n) * mu)).alias("g"),
            F.sum(F.col("__x") * F.col("__x") * F.col(n) * mu * (1 - mu)).alias("h"))

    move = F.coalesce(P.safe_div("g", "h"), F.lit(0.0))
    beta = settled(beta.withColumn("move", F.lit(float("inf"))), lambda b: sums(b).select(*keys, (F.col("beta") + move).alias("beta"), F.abs(move).alias("move")))
    se = 1.0 / F.sqrt(F.nullif(F.col("h"), F.lit(0.0)))
    return sums(beta).select(*keys, "beta", se.alias("se"), (F.col("beta") / se).alias("z"))
