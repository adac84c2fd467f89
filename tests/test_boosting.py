import math
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import boosting as B


def plain_boost(rows, s):
    """Trees of one key: rows (bins, z, y)."""
    trees = []
    k = len(rows[0][0])

    def value(tree, bins):
        node = 1
        for _ in range(s.depth):
            cut = tree["splits"].get(node)
            node = 2 * node + (1 if cut and bins[cut[0]] > cut[1] else 0)
        return tree["leaf"].get(node, 0.0)

    for _ in range(s.rounds):
        tree = {"splits": {}, "leaf": {}}
        nodes = {1: list(range(len(rows)))}
        score = [z + sum(value(t, b) for t in trees) for b, z, _ in rows]
        p = [1 / (1 + math.exp(-x)) for x in score]
        g = [y - q for (_, _, y), q in zip(rows, p)]
        h = [q * (1 - q) for q in p]
        for level in range(s.depth):
            new = {}
            for node, idx in nodes.items():
                best, gt, ht = None, sum(g[i] for i in idx), sum(h[i] for i in idx)
                for f in range(k):
                    for b in sorted({rows[i][0][f] for i in idx}):
                        left = [i for i in idx if rows[i][0][f] <= b]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = round(gl**2 / (hl + s.ridge) + (gt - gl) ** 2 / (ht - hl + s.ridge) - gt**2 / (ht + s.ridge), 9)
                        if min(len(left), len(idx) - len(left)) >= s.min_rows and gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, b, left, gl, hl)
                if best:
                    _, f, b, left, gl, hl = best
                    tree["splits"][node] = (f, b)
                    parts = ((2 * node, left, gl, hl), (2 * node + 1, [i for i in idx if i not in set(left)], gt - gl, ht - hl))
                else:
                    parts = ((2 * node, idx, gt, ht),)
                for child, at, a, c in parts:
                    new[child] = at
                    if level == s.depth - 1:
                        tree["leaf"][child] = s.rate * a / (c + s.ridge)
            nodes = new
        trees.append(tree)
    return trees, value


@pytest.mark.parametrize("refresh", [1, 10])
def test_boosting_against_plain_version(spark, refresh):
    r = random.Random(4)
    s = B.Boosting(rounds=4, depth=3, rate=0.4, ridge=1.0, min_rows=5, refresh=refresh)
    data = {}
    for key in ("a", None, "c"):
        rows = [([r.randint(0, 4), r.randint(0, 2), 0], r.gauss(0, 1)) for _ in range(160)]
        data[key or "b"] = [(b, z, int(r.random() < 1 / (1 + math.exp(-(z + (1.0 if b[0] > 2 else -0.5) * (b[1] == 1)))))) for b, z in rows]
    df = spark.createDataFrame([(k, b, z, y, i) for k, rows in data.items() for i, (b, z, y) in enumerate(rows)], "k string, bins array<int>, z double, y int, i int")
    model = B.boosted(df, ["k"], "bins", "z", "y", s)
    got = {(x.k, x.i): x.raw for x in df.join(model, "k").select("k", "i", B.raw_score(F.col("trees"), F.col("bins"), s.depth).alias("raw")).collect()}
    trees = {x.k: x.trees for x in model.collect()}
    losses = {}
    for k, rows in data.items():
        want, value = plain_boost(rows, s)
        assert [{n: tuple(c) for n, c in t.splits.items()} for t in trees[k]] == [t["splits"] for t in want]
        for i, (b, z, y) in enumerate(rows):
            assert got[(k, i)] == pytest.approx(sum(value(t, b) for t in want), abs=1e-9)
        at = lambda m: sum(-math.log(q if y else 1 - q) for (b, z, y) in rows for q in [1 / (1 + math.exp(-(z + sum(value(t, b) for t in want[:m]))))]) / len(rows)  # noqa: E731,B023
        losses[k] = [at(m) for m in range(s.rounds + 1)]
    for x in B.best_rounds(df, model, ["k"], "bins", "z", "y", s.depth).collect():
        assert x.ll_base == pytest.approx(losses[x.k][0]) and x.ll_head == pytest.approx(min(losses[x.k][1:]))
        assert losses[x.k][x.best_iter] == pytest.approx(x.ll_head)


def test_bins_and_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (0.5, 3.0), (0.6, 4.0), (9.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(B.binned({"a": [0.5, 1.0], "b": []})).collect()] == [[0, 1], [0, 1], [1, 1], [2, 1], [3, 1]]
    assert B.equal_depth_edges(df, ["b"], 2) == {"b": [3.0]}


def test_heads_keep_only_what_gains(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        x, day = r.random(), i // 30
        rows.append(("signal", day, 0.5, int(r.random() < (0.8 if x > 0.5 else 0.2)), x))
        rows.append(("noise", day, 0.5, int(r.random() < 0.5), x))
    rows += [("thin", i, 0.5, i % 2, 0.1) for i in range(50)]
    led = spark.createDataFrame(rows, "family string, d int, p double, y int, x double").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    s = B.Boosting(rounds=3, depth=1, rate=0.5, ridge=1.0, min_rows=20)
    heads, report = B.residual_heads(led, "family", "d", "p", "y", {"x": [0.25, 0.5, 0.75]}, s, least=300)
    got = {x.family: x for x in report.collect()}
    assert got["signal"].status == "active" and got["signal"].gain > 0.05 and got["signal"].n_holdout == 750
    assert got["thin"].status == "skipped" and got["thin"].gain is None
    served = B.apply_heads(led.withColumn("bins", B.binned({"x": [0.25, 0.5, 0.75]})), heads.filter("family <> 'noise'"), ["family"], "bins", "p", 1)
    means = {(x.family, x.hi): x.m for x in served.groupBy("family", (F.col("x") > 0.5).alias("hi")).agg(F.avg("p_head").alias("m")).collect()}
    assert means[("signal", True)] > 0.65 and means[("signal", False)] < 0.35 and means[("noise", True)] == 0.5


def test_a_tree_reads_the_rows_once(spark, monkeypatch):
    """Rows are summed by their bins once a tree; levels, shifts and models read tables of combinations, not of rows."""
    r = random.Random(2)
    rows = [("a", [r.randint(0, 3), r.randint(0, 2)], r.gauss(0, 1), int(r.random() < 0.5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, bins array<int>, z double, y int")
    sizes, real = [], B.cut_lineage

    def counted(d):
        out = real(d)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "cut_lineage", counted)
    s = B.Boosting(rounds=3, depth=2, rate=0.4, ridge=1.0, min_rows=5)
    model = B.boosted(df, ["k"], "bins", "z", "y", s)
    assert sizes[0] == 3000 and sizes.count(12) == 2 * s.rounds - 1 and max(sizes[1:]) == 12
    B.best_rounds(df, model, ["k"], "bins", "z", "y", s.depth).collect()
    assert sizes[-1] == 12
    # no join or aggregation of rows carries trees: the shift of a row comes from the table of its bins
    plan = B.apply_heads(df.withColumn("p", F.lit(0.5)), model.withColumns({"best_iter": F.lit(3), "gain": F.lit(1.0)}), ["k"], "bins", "p", s.depth)._jdf.queryExecution().optimizedPlan().toString()
    assert sizes[-1] == 12 and "trees" not in plan
