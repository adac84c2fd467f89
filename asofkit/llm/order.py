"""Global places of rows in a sorted table, without a window over the table and without the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import fresh, written


def placed(df: DataFrame, by: list[Column], place: str, part: str) -> DataFrame:
    """``df`` written in the order of ``by`` with its global ``place`` (from 0) and the ``part`` it was sorted in.

    One range sort; ties are cut by a row number, so equal rows spread over
    parts. A row's place is the start of its part plus its place there; the
    starts are one row per part.
    """
    names = [place, part, *df.columns]
    row, at, start = (fresh(n, names) for n in ("row_", "at_", "start_"))
    keys = [*by, F.col(row).asc()]
    lined = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lined = written(lined.drop(row).withColumn(at, F.monotonically_increasing_id()), "order").withColumn(part, F.shiftright(at, 33))
    counts = lined.groupBy(part).agg(F.count(F.lit(1)).alias(start))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    starts = counts.select(part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    within = F.col(at).bitwiseAND((1 << 33) - 1)
    return lined.join(F.broadcast(starts), part).withColumn(place, F.col(start) + within).drop(at, start)


def ranked(df: DataFrame, group: str, order: list[Column], rank: str, n: str, place: str | None = None) -> DataFrame:
    """``df`` with each row's ``rank`` within its ``group`` (not null), the group's size and, if named, its global ``place``.

    Groups are contiguous in one global order; their bounds come back by (group,
    part), so the rows of a hot group meet them part by part.
    """
    at = place or fresh("place", [*df.columns, rank, n])
    part, low, size = (fresh(x, [*df.columns, rank, n, at]) for x in ("part", "low", "size"))
    lined = placed(df, [F.col(group).asc(), *order], at, part)
    bounds = lined.groupBy(group, part).agg(F.min(at).alias(low), F.count(F.lit(1)).alias(size))
    w = Window.partitionBy(group)
    bounds = bounds.select(group, part, F.min(low).over(w).alias(low), F.sum(size).over(w).alias(n))
    got = lined.join(bounds, [group, part]).withColumn(rank, F.col(at) - F.col(low)).drop(part, low)
    return got if place else got.drop(at)
