"""Model fitting as data jobs on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.prob import log_loss, logit, recency_weight, sigmoid
from asofkit.functions.vectors import blend_mean, tree_compose
from asofkit.session import cut_lineage


def walk_forward_windows(df: DataFrame, season: str, folds: Sequence[int]) -> DataFrame:
    """Train up to two seasons before, calibrate on the season before, score the fold's season."""
    c = df.groupBy(season).agg(F.count(F.lit(1)).alias("n")).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))
    at = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    s, f = F.col(season), F.col("fold")
    return c.groupBy("fold").agg(at(s <= f - 2).alias("n_train"), at(s == f - 1).alias("n_cal"), at(s == f).alias("n_score")).select(
        "fold", (f - 2).alias("train_to"), (f - 1).alias("calibrate"), f.alias("score"), "n_train", "n_cal", "n_score")


def fit_window(rows: DataFrame, fold: str, date: str) -> DataFrame:
    """First and last day of the rows a fold's fit (training and calibration) has read: kept beside the model."""
    return rows.groupBy(fold).agg(F.min(date).alias("fit_start"), F.max(date).alias("fit_end"))


def judge_folds(scored: DataFrame, windows: DataFrame, fold: str, date: str) -> DataFrame:
    """Per fold its fit window, the days it was scored on and whether the fit ended before them.

    Both ranges come from the rows themselves. A fold without a window, or without days, is not honest.
    """
    days = scored.groupBy(fold).agg(F.min(date).alias("eval_start"), F.max(date).alias("eval_end"))
    return days.join(windows, fold, "left").withColumn("honest", F.coalesce(F.col("fit_end") < F.col("eval_start"), F.lit(False)))


def feature_stages(features: Sequence[str], out: str = "features") -> list:
    """Median imputation, assembly and scaling."""
    filled = [f"{c}__f" for c in features]
    return [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol=out, withMean=True)]


def classifier(label: str, kind: str = "logistic", weight: str | None = None, seed: int = 7, **params):
    kw = {"featuresCol": "features", "labelCol": label, **params}
    if weight:
        kw["weightCol"] = weight
    return {"logistic": lambda: LogisticRegression(family="multinomial", **kw), "binary": lambda: LogisticRegression(family="binomial", **kw),
            "forest": lambda: RandomForestClassifier(seed=seed, **kw), "boosted": lambda: GBTClassifier(seed=seed, **kw)}[kind]()


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", weight: str | None = None, seed: int = 7, **params):
    """Pipeline model for a class index 0..k-1."""
    return Pipeline(stages=[*feature_stages(features), classifier(label, kind, weight, seed, **params)]).fit(train)


def predict(model, rows: DataFrame, out: str) -> DataFrame:
    p = model.transform(rows)
    return p.withColumn(out, vector_to_array("probability")).select(*rows.columns, out)


def recency_weighted(df: DataFrame, date: str, last: Column, half_life_years: float) -> DataFrame:
    return df.withColumn("w", recency_weight(F.datediff(last, date), half_life_years))


def bagged(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, seeds: Sequence[int], kind: str = "forest", **params) -> DataFrame:
    """One fit per seed; the members' vectors are averaged per row and kept for their spread.

    The stages before the fits know no seed: they are fitted once, and their training rows written once for all members.
    """
    stages = Pipeline(stages=feature_stages(features)).fit(train)
    ready = cut_lineage(stages.transform(train).select("features", label))
    out = stages.transform(rows).select(*rows.columns, "features")
    for s in seeds:
        out = predict(classifier(label, kind, seed=s, **params).fit(ready), out, f"__m{s}")
    out = out.drop("features")
    members = F.array(*[F.col(f"__m{s}") for s in seeds])
    return out.withColumn("members", members).withColumn("p", blend_mean("members")).drop(*[f"__m{s}" for s in seeds])


def fit_tree(train: DataFrame, features: Sequence[str], gate: str, kind: str, outcome: str, n_kinds: int, in_class: int, **params) -> dict:
    """Gate over all rows, kind over rows in play, outcome within each kind."""
    inside = train.filter(F.col(gate) == in_class)
    return {"gate": fit_classifier(train, features, gate, **params), "kind": fit_classifier(inside, features, kind, **params),
            "outcome": [fit_classifier(inside.filter(F.col(kind) == k), features, outcome, **params) for k in range(n_kinds)]}


def predict_tree(models: dict, rows: DataFrame) -> DataFrame:
    out = predict(models["gate"], rows, "p_gate")
    out = predict(models["kind"], out, "p_kind")
    for k, m in enumerate(models["outcome"]):
        out = predict(m, out, f"p_out{k}")
    per = F.array(*[F.col(f"p_out{k}") for k in range(len(models["outcome"]))])
    return out.withColumn("p_tree", tree_compose("p_gate", "p_kind", per))


def vector_scaling(cal: DataFrame, p: str, label: str, reg: float = 0.0):
    """Multinomial calibration: logistic regression on log probabilities."""
    x = cal.withColumn("features", _log_vec(p))
    return LogisticRegression(family="multinomial", featuresCol="features", labelCol=label, regParam=reg, maxIter=50).fit(x)


def _log_vec(p: str) -> Column:
    return array_to_vector(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-9)))))


def scaled(model, rows: DataFrame, p: str, out: str) -> DataFrame:
    t = model.transform(rows.withColumn("features", _log_vec(p)))
    return t.withColumn(out, vector_to_array("probability")).select(*rows.columns, out)


def anchored(p: Column, truth: Column, mean: Column) -> Column:
    """Shift a probability in logit space so that its mean level moves from ``mean`` to ``truth``."""
    return sigmoid(logit(p) + logit(truth) - logit(mean))


def evaluate_folds(scored: DataFrame, fold: str, y: str, p: str, honest: str | None = None) -> DataFrame:
    """Log loss per fold and the exposure-weighted mean over honest folds (fold NULL)."""
    r = scored.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(y, p)).alias("ll"), *([F.min(honest).alias("honest")] if honest else [F.lit(True).alias("honest")]))
    total = r.filter("honest").agg(F.lit(None).cast("int").alias(fold), F.sum("n").alias("n"), (F.sum(F.col("ll") * F.col("n")) / F.sum("n")).alias("ll"), F.lit(True).alias("honest"))
    return r.select(fold, "n", "ll", "honest").unionByName(total.select(fold, "n", "ll", "honest"))
