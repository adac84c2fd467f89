"""Which of the rested arms of a group was chosen: eligibility over two days, workload tiers, ranks by context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.asof import day_number
from asofkit.operators.scan import top_k


def nth_arm(first_uses: DataFrame, group: Sequence[str], date: str, arm: str, order: str, n: int = 2) -> DataFrame:
    """The ``n``-th arm that a group used on a day, by its first use (``order``); the others' columns come along."""
    return top_k(first_uses, [*group, date], [F.col(order), F.col(arm)], n, "__nth").filter(F.col("__nth") == n).drop("__nth")


def rested_pool(
    uses: DataFrame, choices: DataFrame, group: Sequence[str], arm: str, date: str, n: str, load: str, totals: Sequence[str], recent: int = 30, history: int = 365
) -> DataFrame:
    """Candidates of every choice with what they did before its day.

    ``uses`` holds one row per (group, arm, day). Every use makes its arm a candidate until its
    next use, ``recent`` days at most, so candidates grow with the uses and not with arms times
    days. Candidates and uses then share one window per arm, bounded by the calendar: ``n_1``,
    ``n_2`` and ``load_1``, ``load_2`` of the last day and the one before, ``n_recent``, and
    ``<total>_history`` besides ``n_history``. Sums are whole numbers and come as differences of
    running sums, so a row costs the same however long its frame is.
    """
    key, w = [*group, arm], Window.partitionBy(*group, arm)
    last = F.date_add(date, recent)
    until = F.least(last, F.coalesce(F.lead(date).over(w.orderBy(date)), last))
    open_days = uses.withColumn("__until", until).select(*key, F.explode(F.sequence(F.date_add(date, 1), "__until")).alias(date))
    asks = open_days.join(choices, [*group, date]).withColumn("__ask", F.lit(True))
    both = asks.unionByName(uses.select(*key, date, n, load, *totals), allowMissingColumns=True).withColumn("__day", day_number(F.col(date)))
    over = w.orderBy("__day")
    so_far = lambda c, b: F.coalesce(F.sum(c).over(over.rangeBetween(Window.unboundedPreceding, -b)), F.lit(0))
    before = lambda c, a, b: so_far(c, b) - so_far(c, a + 1)
    out = [before(c, lag, lag).alias(f"{name}_{lag}") for name, c in (("n", n), ("load", load)) for lag in (1, 2)]
    out += [before(n, recent, 1).alias("n_recent"), *[before(c, history, 1).alias(f"{c}_history") for c in dict.fromkeys([n, *totals])]]
    return both.select(*asks.columns, *out).filter("__ask").drop("__ask")


def eligible(n: int = 0, most: int = 25) -> Column:
    """Not used on both of the last two days, and fewer than ``most`` units of load on the last one."""
    return ~((F.col("n_1") > n) & (F.col("n_2") > n)) & (F.col("load_1") < most)


def workload_tier(heavy: int = 20, light: int = 10) -> Column:
    """2 after a heavy day or two days with load, 1 after a light one, else 0."""
    one, two = F.col("load_1"), F.col("load_2")
    return F.when((one >= heavy) | ((one > 0) & (two > 0)), 2).when(one >= light, 1).otherwise(0)
