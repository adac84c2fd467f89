"""Logistic regression with several terms, per key, by Newton steps on grouped sums: estimates, standard errors and z values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.session import cut_lineage


def design(terms: dict[str, str]) -> Column:
    """Row of the design: an intercept, then the terms (SQL expressions by name)."""
    return F.array(F.lit(1.0), *[F.expr(t).cast("double") for t in terms.values()])


def fit_logistic(cells: DataFrame, key: str, terms: dict[str, str], n: str, sy: str, offset: Column | None = None, ridge: float = 0.0, tol: float = 1e-9, limit: int = 25) -> DataFrame:
    """(key, term, beta, se, z, settled) for every key: ``cells`` hold rows folded to (key, terms), their number ``n`` and positives ``sy``.

    A step is one aggregation over the cells of k * (k + 3) / 2 sums for all keys. The driver
    solves one k x k system per key, so keys are few (families, causes), rows are not.
    Keys that do not settle (separable outcomes) are returned with what they had and ``settled`` false.
    """
    names, spark = ["intercept", *terms], cells.sparkSession
    k = len(names)
    cells = cut_lineage(cells.select(F.col(key), design(terms).alias("x"), F.col(n).cast("double").alias("n"), F.col(sy).cast("double").alias("sy"), (F.lit(0.0) if offset is None else offset).alias("z")))
    keys = [r[0] for r in cells.select(key).distinct().collect()]
    beta, done = {a: np.zeros(k) for a in keys}, {a: False for a in keys}

    def sums() -> dict:
        table = spark.createDataFrame([(a, [float(v) for v in beta[a]]) for a in keys], f"`{key}` {cells.schema[key].dataType.simpleString()}, beta array<double>")
        eta = F.col("z") + F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        mu = P.sigmoid(eta)
        c = cells.join(table, key).withColumn("w", F.col("n") * mu * (1 - mu)).withColumn("r", F.col("sy") - F.col("n") * mu)
        x = lambda i: F.get("x", i)
        got = c.groupBy(key).agg(*[F.sum(F.col("r") * x(i)).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("w") * x(i) * x(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)])
        out = {}
        for r in got.collect():
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
            out[r[key]] = h, np.array([r[f"g{i}"] for i in range(k)]) - ridge * beta[r[key]]
        return out

    if keys:
        for _ in range(limit):
            for a, (h, g) in sums().items():
                if not done[a] and np.linalg.cond(h) < 1e14:
                    step = np.linalg.solve(h, g)
                    beta[a] = beta[a] + step
                    done[a] = bool(np.abs(step).max() < tol)
            if all(done.values()):
                break
        last = sums()
    rows = []
    for a in keys:
        h = last[a][0]
        se = np.sqrt(np.diag(np.linalg.inv(h))) if np.linalg.cond(h) < 1e14 else np.full(k, np.nan)
        rows += [(a, t, float(b), None if np.isnan(e) else float(e), None if np.isnan(e) else float(b / e), done[a]) for t, b, e in zip(names, beta[a], se, strict=True)]
    return spark.createDataFrame(rows, f"`{key}` {cells.schema[key].dataType.simpleString()}, term string, beta double, se double, z double, settled boolean")


def coefficients(fit: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key, beta): the estimates of each settled key as an array in the order of the design."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(["intercept", *terms]) for x in (t, i)])
    got = fit.filter("settled").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.element_at(order, F.col("term")).alias("i"), "beta"))).alias("b"))
    return got.select(key, F.transform("b", lambda s: s["beta"]).alias("beta"))


def score(df: DataFrame, coefs: DataFrame, key: str, terms: dict[str, str], out: str, offset: Column | None = None) -> DataFrame:
    """``df`` with the probability of its key's fit; null where there is none."""
    eta = (F.lit(0.0) if offset is None else offset) + F.aggregate(F.zip_with(design(terms), F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return df.join(coefs, key, "left").withColumn(out, F.when(F.col("beta").isNotNull(), P.sigmoid(eta))).drop("beta")
