"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in one
task. Here each key is cut into chunks that follow the order (a day, a bucket of
a score). The window runs per (key, chunk); one row per (key, chunk) carries the
totals, and a second window over those few rows gives each chunk what came
before it. Results equal the single window exactly.

``chunk`` must be monotone in the first order column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """Running sum of ``value``; ``inclusive=False`` leaves out the current row."""

    out: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Index:
    """1-based position of the row within its key."""

    out: str


@dataclass(frozen=True)
class Previous:
    """Value of the row just before (NULL for the first)."""

    out: str
    value: Column


@dataclass(frozen=True)
class Following:
    """Value of the row just after (NULL for the last)."""

    out: str
    value: Column


@dataclass(frozen=True)
class Carry:
    """Latest non-NULL value at or before the row (strictly before if not inclusive)."""

    out: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMin:
    """Running minimum, current row included."""

    out: str
    value: Column


@dataclass(frozen=True)
class Total:
    """Sum over the whole key."""

    out: str
    value: Column


Scan = Running | Index | Previous | Following | Carry | RunningMin | Total


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` that also matches NULL with NULL; right keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__k_{k}"])
    return left.join(r, cond, how).drop(*[f"__k_{k}" for k in keys])


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column, scans: Sequence[Scan]
) -> DataFrame:
    keys = list(keys)
    # One struct of keys and chunk: NULL keys equal each other in it, and the join below reuses the window's partitioning.
    base = df.withColumn("__chunk", chunk).withColumn("__gk", F.struct(*keys, "__chunk"))
    # Order columns and inputs are named so both levels see the same values.
    for i, o in enumerate(order):
        base = base.withColumn(f"__o{i}", F.col(o) if isinstance(o, str) else o)
    for i, s in enumerate(scans):
        if not isinstance(s, Index):
            base = base.withColumn(f"__v{i}", s.value)
    ocols = [F.col(f"__o{i}") for i in range(len(order))]
    rank = F.struct(*ocols)
    w = Window.partitionBy("__gk").orderBy(*ocols)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wc = Window.partitionBy(*keys).orderBy("__chunk")
    cbefore = wc.rowsBetween(Window.unboundedPreceding, -1)

    part_aggs, part_outs, local, final = [], [], [], []
    for i, s in enumerate(scans):
        v, p, q, loc = F.col(f"__v{i}"), f"__p{i}", f"__q{i}", f"__l{i}"
        boxed = F.when(v.isNotNull(), F.struct(v.alias("x"))) if not isinstance(s, Index) else None
        if isinstance(s, Running):
            part_aggs.append(F.sum(v).alias(p))
            part_outs.append(F.coalesce(F.sum(p).over(cbefore), F.lit(0)).alias(q))
            local.append(F.coalesce(F.sum(v).over(upto if s.inclusive else before), F.lit(0)).alias(loc))
            final.append((F.col(loc) + F.col(q)).alias(s.out))
        elif isinstance(s, Index):
            part_aggs.append(F.count(F.lit(1)).alias(p))
            part_outs.append(F.coalesce(F.sum(p).over(cbefore), F.lit(0)).alias(q))
            local.append(F.row_number().over(w).cast("long").alias(loc))
            final.append((F.col(loc) + F.col(q)).alias(s.out))
        elif isinstance(s, Previous):
            part_aggs.append(F.max_by(F.struct(v.alias("x")), rank).alias(p))
            part_outs.append(F.lag(p).over(wc).alias(q))
            local.append(F.lag(F.struct(v.alias("x"))).over(w).alias(loc))
            final.append(F.coalesce(F.col(loc), F.col(q))["x"].alias(s.out))
        elif isinstance(s, Following):
            part_aggs.append(F.min_by(F.struct(v.alias("x")), rank).alias(p))
            part_outs.append(F.lead(p).over(wc).alias(q))
            local.append(F.lead(F.struct(v.alias("x"))).over(w).alias(loc))
            final.append(F.coalesce(F.col(loc), F.col(q))["x"].alias(s.out))
        elif isinstance(s, Carry):
            part_aggs.append(F.max_by(boxed, F.when(v.isNotNull(), rank)).alias(p))
            part_outs.append(F.last(p, True).over(cbefore).alias(q))
            local.append(F.last(boxed, True).over(upto if s.inclusive else before).alias(loc))
            final.append(F.coalesce(F.col(loc), F.col(q))["x"].alias(s.out))
        elif isinstance(s, Total):
            part_aggs.append(F.sum(v).alias(p))
            part_outs.append(F.sum(p).over(Window.partitionBy(*keys)).alias(q))
            final.append(F.col(q).alias(s.out))
        else:
            part_aggs.append(F.min(v).alias(p))
            part_outs.append(F.min(p).over(cbefore).alias(q))
            local.append(F.min(v).over(upto).alias(loc))
            final.append(F.least(F.col(loc), F.col(q)).alias(s.out))

    parts = base.groupBy("__gk").agg(*part_aggs).select("__gk", "__gk.*", *[f"__p{i}" for i in range(len(scans))]).select("__gk", *part_outs)
    rows = base.select(*df.columns, "__gk", *local)
    return rows.join(parts, "__gk", "left").select(*df.columns, *final)


def group_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to rows: partial aggregation, then an equi join.

    Unlike an un-ordered window, this never gathers a hot group in one task.
    """
    if not keys:
        return df.select("*", *[df.agg(a).scalar().alias(n) for n, a in aggs.items()])
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return null_safe_join(df, totals, list(keys))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rn") -> DataFrame:
    """First ``k`` rows per key. The rank filter is pushed below the shuffle by Spark
    (window group limit), so at most k rows per key and task move."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, keys, order, 1, "__rn").drop("__rn")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bucket: Column
) -> DataFrame:
    """Linear-interpolated quantiles per key without gathering the key in one task.

    Equal values are first counted together (map-side), then positions come from
    an ordered scan over distinct values in chunks of ``bucket`` (monotone in value).
    Output: keys..., prob, quantile.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, probs, bucket)
        return one.drop("__all")
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_scan(counts, keys, [F.col(value)], bucket, [Running("__hi", F.col("__n"))])
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    want = total.select(*keys, "__t", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).withColumn(
        "__pos", F.col("prob") * (F.col("__t") - 1)
    )
    # Each distinct value covers positions [hi-n, hi-1]; probs is a short fixed list per key.
    hit = null_safe_join(ranked, want, keys, "inner")
    lo, hi = F.col("__hi") - F.col("__n"), F.col("__hi") - 1
    down, up = F.floor("__pos"), F.ceil("__pos")
    hit = hit.filter(((down >= lo) & (down <= hi)) | ((up >= lo) & (up <= hi)))
    frac = F.max(F.col("__pos") - F.floor("__pos"))
    a = F.max(F.when((down >= lo) & (down <= hi), F.col(value)))
    b = F.max(F.when((up >= lo) & (up <= hi), F.col(value)))
    return hit.groupBy(*keys, "prob").agg((a + (b - a) * frac).alias("quantile"))
