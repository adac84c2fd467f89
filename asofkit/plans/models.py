"""Model fitting jobs on the given tables (checked by property tests, not by an oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.functions import vectors as V
from asofkit.operators import learn as M
from asofkit.plans._roles import LABELS, appearances, table
from asofkit.registry import query
from asofkit.session import cut_lineage

FEATS = ["qty", "disc", "tax", "prior"]
#: Settings of the fits: iterations of a linear model (it stops at its tolerance before), trees and their depth.
ITERS, TREES, DEPTH = 100, 20, 5


def training_rows(spark, d):
    """Appearances with a prior-season rate as a feature and class indexes as labels."""
    from asofkit.operators.shrink import class_counts, prior_season

    pa = appearances(spark, d)
    rate = class_counts(pa, ["pitcher", "season"], "label", LABELS).select("pitcher", "season", (F.col("cR") / F.col("n")).alias("prior"))
    rows = prior_season(pa, rate, ["pitcher"], "season", "season", ["prior"])
    label = F.when(F.col("label") == "cA", 0.0).when(F.col("label") == "cN", 1.0).otherwise(2.0)
    rows = rows.select("game", "d", "season", *FEATS, label.alias("y"), (F.col("price") > 50000).cast("double").alias("hi"),
                       F.when(F.col("status") == "O", 1.0).otherwise(0.0).alias("open"))
    return cut_lineage(rows)  # fits and predictions read them many times: one join, not one per reader


@query("M2 M4 X28")
def time_split_classifier(spark, d):
    """Fit before the calibration season, scale on it, evaluate after it; recency-weighted training rows."""
    r = training_rows(spark, d)
    tr = M.recency_weighted(r.filter("season < 1999"), "d", F.lit("1998-12-31").cast("date"), 2.0)
    m = M.fit_classifier(tr, FEATS, "y", "logistic", weight="w", maxIter=ITERS)
    cal, te = (M.predict(m, r.filter(f), "p") for f in ("season = 1999", "season >= 2000"))
    sc = M.scaled(M.vector_scaling(cal, "p", "y", 0.01), te, "p", "p_cal")
    ll = lambda c: F.round(F.avg(V.vector_log_loss(c, F.col("y") + 1)), 5)
    return sc.groupBy("season").agg(F.count(F.lit(1)).alias("n"), ll("p").alias("ll_raw"), ll("p_cal").alias("ll_cal"), F.round(F.avg(V.asum(F.col("p_cal"))), 6).alias("mass"))


@query("M3 X23")
def class_tree(spark, d):
    """Gate, kind and outcome models composed back to one vector that sums to one."""
    r = training_rows(spark, d)
    tr = r.filter("season < 2000").withColumn("gate", F.when(F.col("y") == 2.0, 1.0).otherwise(0.0))
    m = M.fit_tree(tr, FEATS, "gate", "hi", "open", 2, 1, maxIter=ITERS)
    te = M.predict_tree(m, r.filter("season >= 2000"))
    return te.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(V.asum(F.col("p_tree"))), 6).alias("min_mass"), F.round(F.max(V.asum(F.col("p_tree"))), 6).alias("max_mass"),
                                    F.round(F.avg(F.element_at("p_tree", 1)), 4).alias("p_out"))


@query("M14 X24")
def bagged_forest(spark, d):
    """Two seeds averaged; the members' spread comes along."""
    r = training_rows(spark, d)
    b = M.bagged(r.filter("season < 1998"), r.filter("season >= 1998"), FEATS, "y", [1, 2], "forest", numTrees=TREES, maxDepth=DEPTH)
    return b.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.member_logit_std("members", 1)), 5).alias("spread"),
                                   F.round(F.avg(V.vector_log_loss("p", F.col("y") + 1)), 5).alias("ll"))


@query("M8 M5")
def walk_forward(spark, d):
    """Rolling origin: train, calibrate with a Platt map, score; honest folds pooled by exposure."""
    from asofkit.operators import evaluation as E

    r = training_rows(spark, d)
    scored = windows = None
    for fold in (1998, 1999, 2000, 2001):
        m = M.fit_classifier(r.filter(F.col("season") <= fold - 2), FEATS, "open", "binary", maxIter=ITERS)
        one = M.predict(m, r.filter(F.col("season").isin(fold - 1, fold)), "v").select(
            F.lit(fold).alias("fold"), (F.col("season") == fold).alias("late"), "d", "open", F.element_at("v", 2).alias("p"))
        seen = M.fit_window(r.filter(F.col("season") < fold).withColumn("fold", F.lit(fold)), "fold", "d")
        scored, windows = (one, seen) if scored is None else (scored.unionByName(one), windows.unionByName(seen))
    scored = cut_lineage(scored)  # every fold's two seasons scored once; the maps of all folds settle together
    ab = E.platt_maps(scored.filter("NOT late").select("fold", "p", F.col("open").cast("int").alias("y")), ["fold"], 500)
    out = scored.filter("late").join(ab.select("fold", "a", "b"), "fold", "left")
    out = out.withColumn("p_cal", F.when(F.col("a").isNull(), F.col("p")).otherwise(P.platt("p", "a", "b")))
    honest = M.judge_folds(out, windows, "fold", "d").select("fold", F.col("honest").alias("__h"))
    out = out.join(honest, "fold").withColumn("honest", F.col("__h") & F.col("a").isNotNull())
    return M.evaluate_folds(out, "fold", "open", "p_cal", "honest").select("fold", "n", F.round("ll", 5).alias("ll"), "honest")


@query("M11")
def anchored_attempts(spark, d):
    """Imputed, scaled logistic whose level is moved to the true rate."""
    r = training_rows(spark, d)
    train = r.filter("season < 2000")
    m = M.fit_classifier(train, FEATS, "hi", "binary", maxIter=ITERS)
    p = M.predict(m, r.filter("season >= 2000"), "v").withColumn("p", F.element_at("v", 2))
    fit = M.predict(m, train, "v")  # the level comes from the training seasons alone
    mean, level = fit.agg(F.avg(F.element_at("v", 2))).scalar(), train.agg(F.avg("hi")).scalar()
    a = p.withColumn("p_mean", mean).withColumn("p_level", level).withColumn("p_anchored", M.anchored(F.col("p"), F.col("p_level"), F.col("p_mean")))
    return a.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 5).alias("p_model"), F.round(F.avg("p_anchored"), 5).alias("p_anchored"), F.round(F.avg("hi"), 5).alias("truth"))


@query("M2")
def boosted_labels(spark, d):
    """Binary boosted trees on document features against the quality label."""
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    r = lab.select("doc_id", F.log1p("n_chars").alias("size"), F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("double").alias("y"))
    m = M.fit_classifier(r.filter("doc_id % 4 <> 0"), ["size", "toxic"], "y", "boosted", maxIter=TREES, maxDepth=DEPTH)
    te = M.predict(m, r.filter("doc_id % 4 = 0"), "v")
    return te.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(P.log_loss("y", F.element_at("v", 2))), 5).alias("ll"), F.round(F.avg("y"), 5).alias("base"))
