import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.plans import scores


def _led(spark, close_rows):
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        market = ("a", "b", "tiny")[0 if i % 3 == 0 else 1 if i % 40 else 2]
        p = rnd.uniform(0.05, 0.95)
        rows.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 12), "fam", market, i % 50, p, int(rnd.random() < p * (0.5 if market == "a" else 1.0))))
    led = spark.createDataFrame(rows, "game long, d date, family string, market string, entity long, p double, y int").withColumn("mk", F.lit("m0"))
    prices = spark.createDataFrame([(e, "m0", 0.5) for e in range(close_rows)], "entity long, mk string, pc double")
    return led, prices, rows


@pytest.mark.parametrize(("close_rows", "given"), [(50, True), (3, False)])
def test_point_score_and_close_pillar(spark, close_rows, given):
    led, prices, rows = _led(spark, close_rows)
    vs = scores.close_edge(led, prices, 800)
    got = scores.market_scores(led.drop("mk"), vs, 8, 3).collect()
    assert sorted(r.rep for r in got) == list(range(9))
    point = next(r for r in got if r.rep == 0)
    assert point.markets == 2  # the market under a hundred rows stays out
    assert (point.vs_close is not None) == given and all(r.vs_close == point.vs_close for r in got)
    aucs = []
    for m in "ab":
        sub = [(min(int(p * 200), 199), y) for _, _, _, mk, _, p, y in rows if mk == m]
        pos, neg = [c for c, y in sub if y], [c for c, y in sub if not y]
        aucs.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert point.auc == pytest.approx(sum(aucs) / 2)
    assert 0 <= point.score <= 100


def test_no_market_large_enough(spark):
    led, prices, _ = _led(spark, 50)
    few = led.filter("game < 60")
    assert scores.market_scores(few.drop("mk"), scores.close_edge(few, prices, 800), 3, 3).count() == 0
