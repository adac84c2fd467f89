"""Positions in a whole table without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def global_rank(df: DataFrame, order: Sequence[Column], chunk: Column, out: str) -> DataFrame:
    """1-based position of every row in ``order``; ``chunk`` is monotone in that order.

    Rows are numbered within their chunk in parallel; only one row per chunk is seen by the
    window that adds the offsets. Sort directions are folded into a rank-safe struct by the caller.
    """
    from pyspark.sql import Window

    base = df.withColumn("__chunk", chunk)
    w = Window.partitionBy("__chunk").orderBy(*order)
    rows = base.withColumn("__i", F.row_number().over(w))
    size = base.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = size.select("__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return rows.join(off, "__chunk").withColumn(out, F.col("__i") + F.col("__off")).select(*df.columns, out)


