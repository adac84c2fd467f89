"""Aggregations: sufficient statistics, patterns, hazards, exits, choice ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.prob import logit, sigmoid
from asofkit.operators.scan import group_totals, top_k


def sufficient_stats(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Count, sum and sum of squares of each measure where its condition holds, in one pass.

    Rows go to their group as they are: three sums per measure are wider than a row, so partial sums of
    groups of few rows would shuffle more. Sums stream, so a large group costs its task time and no memory.
    """
    aggs = []
    for name, (value, cond) in measures.items():
        v = F.when(cond, value.cast("double"))
        aggs += [F.count(v).alias(f"{name}_n"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}_v"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"{name}_vv")]
    return df.repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def grouped_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int) -> DataFrame:
    """Least-squares slope per group with enough rows, kept as weight and slope*weight so sums average it."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    ok = fx.isNotNull() & fy.isNotNull()
    s = df.filter(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fy).alias("sxy"), F.sum(fx * fx).alias("sxx"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(den, F.lit(0.0))
    r = s.filter(F.col("n") >= min_n).withColumn("slope", slope).filter("slope IS NOT NULL")
    return r.select(*keys, F.col("n").alias("w"), (F.col("slope") * F.col("n")).alias("slope_w"))


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*first), rank).alias("__f"), F.max_by(F.struct(*last), rank).alias("__l")).select(
        *keys, *[F.col(f"__f.{c}").alias(f"{c}_first") for c in first], *[F.col(f"__l.{c}").alias(f"{c}_last") for c in last])


def weighted_skip(value: Column, weight: Column) -> Column:
    """Weighted mean that skips missing values and stays NULL when all are missing."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def movement_patterns(
    moves: DataFrame, play: Sequence[str], runner: str, order: Sequence[str], start: str, end: str, out: str, slots: Sequence[str], held: int = 9
) -> DataFrame:
    """Collapse each runner's segments to origin and final place, then one row of slot destinations per play."""
    rank = F.struct(*order)
    r = moves.groupBy(*play, runner).agg(F.min_by(start, rank).alias("__s"), F.max_by(end, rank).alias("__e"), F.max(out).alias("__o"))
    dest = F.when(F.col("__o") == 1, 0).when(F.col("__e") == F.col("__s"), held).otherwise(F.col("__e"))
    r = r.withColumn("__d", dest.cast("int"))
    wide = r.groupBy(*play).agg(
        *[F.coalesce(F.max(F.when(F.col("__s") == s, F.col("__d"))), F.lit(held)).alias(f"s{s}") for s in slots],
        F.sum("__o").alias("outs"), F.count_if(F.col("__d") == 4).alias("runs"))
    return wide


def pattern_distribution(plays: DataFrame, keys: Sequence[str], pattern: Sequence[str]) -> DataFrame:
    n = plays.groupBy(*keys, *pattern).agg(F.count(F.lit(1)).alias("n"))
    return group_totals(n, keys, __t=F.sum("n")).withColumn("p", F.col("n") / F.col("__t")).drop("__t")


def event_rate(events: DataFrame, key: Sequence[str], exposure: DataFrame, name: str) -> DataFrame:
    """Distinct event keys per unit of exposure."""
    n = events.select(*key).distinct().agg(F.count(F.lit(1)).alias("n_events"))
    return n.withColumn("n_exposed", exposure.agg(F.count(F.lit(1))).scalar()).select(
        F.lit(name).alias("event"), "n_events", (F.col("n_events") / F.greatest("n_exposed", F.lit(1))).alias("rate"))


def conditional_offsets(df: DataFrame, on: Column, labels: dict[str, Column]) -> DataFrame:
    """Log ratio of each label's rate given the condition (and its complement) to the overall rate."""
    a = df.agg(*[x for n, c in labels.items() for x in (
        F.avg(c.cast("double")).alias(f"all_{n}"), F.avg(F.when(on, c.cast("double"))).alias(f"on_{n}"), F.avg(F.when(~on, c.cast("double"))).alias(f"off_{n}"))],
        F.avg(on.cast("double")).alias("w_on"))
    return a.select("w_on", *[x for n in labels for x in (F.log(F.col(f"on_{n}") / F.col(f"all_{n}")).alias(f"d{n}_on"), F.log(F.col(f"off_{n}") / F.col(f"all_{n}")).alias(f"d{n}_off"))])


def logit_split(df: DataFrame, entity: str, on: Column, hit: Column, min_n: int) -> DataFrame:
    a = df.groupBy(entity).agg(F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"), F.count_if(on & hit).alias("k_on"), F.count_if(~on & hit).alias("k_off"))
    a = a.filter((F.col("n_on") >= min_n) & (F.col("n_off") >= min_n))
    return a.select(entity, (logit(F.col("k_on") / F.col("n_on"), 1e-3) - logit(F.col("k_off") / F.col("n_off"), 1e-3)).alias("dlogit"))


def hazard_cells(risk: DataFrame, cells: Sequence[str], marginal: Sequence[str], event: str, k: float) -> DataFrame:
    """Event rate per cell, shrunk by k rows to its marginal."""
    g = risk.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("ev"))
    m = risk.groupBy(*marginal).agg(F.avg(F.col(event).cast("double")).alias("__m"))
    return g.join(m, list(marginal)).withColumn("rate", (F.col("ev") + k * F.col("__m")) / (F.col("n") + k))


def backfill_cells(rates: DataFrame, axes: dict[str, Sequence[int]], marginal: Sequence[str]) -> DataFrame:
    """Dense grid over the fixed axis values; empty cells take their marginal, then the overall mean.

    The grid's size is the product of the axis vocabularies, built by exploding literal arrays.
    """
    grid = rates.agg(F.avg("__m").alias("__all"))
    for a, vals in axes.items():
        grid = grid.withColumn(a, F.explode(F.array(*[F.lit(v) for v in vals])))
    m = rates.select(*marginal, F.col("__m").alias("__mm")).distinct()
    j = grid.join(rates.select(*axes, "n", "rate"), list(axes), "left").join(m, list(marginal), "left")
    return j.select(*axes, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", "__mm", "__all").alias("rate"), F.col("rate").isNull().alias("filled"))


def era_anchor(risk: DataFrame, rates: DataFrame, cells: Sequence[str], event: str, season: str, n0: float = 30000.0) -> Column:
    """Logit shift that moves the pooled grid toward the newest season's level, shrunk by n0 rows."""
    top = risk.agg(F.max(season)).scalar()
    cur = risk.filter(F.col(season) == top).join(rates.select(*cells, "rate"), list(cells))
    a = cur.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(event).cast("double")).alias("act"), F.avg("rate").alias("prd"))
    return a.select(F.col("n") / (F.col("n") + n0) * (logit("act", 1e-9) - logit("prd", 1e-9))).scalar()


def shift_rate(rate: Column, delta: Column) -> Column:
    return sigmoid(logit(rate, 1e-9) + delta)


def exit_table(durations: DataFrame, keys: Sequence[str], dur: str, top: int = 10) -> DataFrame:
    """Exit probability at each duration k: 1 - #(> k) / #(>= k), from duration counts."""
    n = durations.groupBy(*keys, F.least(dur, F.lit(top + 1)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    grid = n.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top + 1))))
    full = grid.join(n, [*keys, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("at_risk", F.sum("n").over(w))
    return full.filter(F.col("k") <= top).select(*keys, "k", "at_risk", F.try_divide(F.col("n").cast("double"), F.nullif(F.col("at_risk"), F.lit(0))).alias("exit"))


def blended_exit(own: DataFrame, league: DataFrame, keys: Sequence[str], pseudo: float = 12.0) -> DataFrame:
    """Own exit rates blended with ``pseudo`` league stints."""
    j = own.join(league.select("k", F.col("exit").alias("__lg")), "k")
    return j.withColumn("exit", (F.coalesce("exit", F.lit(0.0)) * F.col("at_risk") + pseudo * F.coalesce("__lg", F.lit(0.0))) / (F.col("at_risk") + pseudo)).drop("__lg")


def choice_rank_pmf(
    candidates: DataFrame, choice: Sequence[str], orderings: dict[str, Sequence[Column]], context: str, chosen: str, use: Sequence[Column], size: int
) -> DataFrame:
    """Rank of the chosen candidate under the ordering of its context, as a distribution over ranks.

    The ``size`` most used candidates of a choice (first by ``use``) pass the shuffle and are then
    ordered. ``orderings`` gives each context its ascending sort values (same number for all); one
    window serves every context.
    """
    width = len(next(iter(orderings.values())))
    order = []
    for i in range(width):
        pick = None
        for ctx, cols in orderings.items():
            hit = F.col(context) == ctx
            pick = F.when(hit, cols[i].cast("double")) if pick is None else pick.when(hit, cols[i].cast("double"))
        order.append(pick)
    used = top_k(candidates, list(choice), use, size, "__use").drop("__use")
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy(*choice).orderBy(*order))).filter(F.col(chosen))
    n = ranked.groupBy(context, "rank").agg(F.count(F.lit(1)).alias("n"))
    return group_totals(n, [context], __t=F.sum("n")).select(context, "rank", "n", (F.col("n") / F.col("__t")).alias("p"))


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value), F.max("__n").alias("n"))


