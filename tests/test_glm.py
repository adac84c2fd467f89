import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.operators import glm as G


def plain(x, z, n, sy, steps=40):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-(z + x @ beta)))
        h = x.T @ (x * (n * mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (sy - n * mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_estimates_errors_and_scores_per_key(spark):
    r = random.Random(2)
    rows = [(k, r.random(), r.randint(0, 1), r.gauss(0, 0.3), 5) for k in ("a", "b") for _ in range(120)]
    rows = [(k, a, b, z, n, int(sum(r.random() < 1 / (1 + np.exp(-(z - 0.5 + (1 if k == "a" else -1) * a + 0.7 * b))) for _ in range(n)))) for k, a, b, z, n in rows]
    df = spark.createDataFrame(rows, "k string, a double, b int, z double, n int, sy int")
    terms = {"a": "a", "ab": "a * b"}
    fit = G.fit_logistic(df, "k", terms, "n", "sy", F.col("z"))
    got = {(x.k, x.term): x for x in fit.collect()}
    coefs = G.coefficients(fit, "k", list(terms))
    p = {(x.k, round(x.a, 9)): x.p for x in G.score(df, coefs, "k", terms, "p", F.col("z")).collect()}
    for k in ("a", "b"):
        mine = [x for x in rows if x[0] == k]
        x = np.array([[1, v[1], v[1] * v[2]] for v in mine])
        beta, se = plain(x, np.array([v[3] for v in mine]), np.array([v[4] for v in mine]), np.array([v[5] for v in mine]))
        for i, t in enumerate(("intercept", "a", "ab")):
            assert got[(k, t)].beta == pytest.approx(beta[i], abs=1e-7) and got[(k, t)].se == pytest.approx(se[i], rel=1e-6) and got[(k, t)].settled
        for v, row in zip(mine, x):
            assert p[(k, round(v[1], 9))] == pytest.approx(1 / (1 + np.exp(-(v[3] + row @ beta))), abs=1e-7)


def test_separable_and_empty_keys(spark):
    df = spark.createDataFrame([("s", float(i), 1, int(i > 4)) for i in range(10)] + [("ok", float(i), 2, 1) for i in range(10)], "k string, a double, n int, sy int")
    fit = G.fit_logistic(df, "k", {"a": "a"}, "n", "sy", limit=30)
    assert {x.k: x.settled for x in fit.collect()} == {"s": False, "ok": True}
    assert [x.k for x in G.coefficients(fit, "k", ["a"]).collect()] == ["ok"]
    assert G.fit_logistic(df.limit(0), "k", {"a": "a"}, "n", "sy").count() == 0
