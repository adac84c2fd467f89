"""Shards cut from a Hilbert curve over metadata.

Each dimension is cut at equal-depth quantiles, the cells are numbered along a
Hilbert curve, rows are sorted by that number and runs of equal row counts
become shards, so a file covers a small box in every dimension and min/max
statistics prune on each of them.

Cases: a null value counts as the lowest of its dimension; a null text has no
bytes; ties and repeated rows are ordered by their place in the input, so a hot
value is cut like any other run; fewer rows than shards leave shards empty; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.llm.common import written

BITS = 4


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of ``cells``, each value under 2**bits)."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, highest bit first
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def as_number(name: str) -> Column:
    """A number in the column's order, null lowest."""
    return F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double")), F.lit(-1e300))


def text_edges(df: DataFrame, name: str, bits: int) -> list:
    """Equal-depth cuts of a text column on its whole values: the value at every 2**bits-th part of the rows, null lowest.

    Distinct values are counted before they move, sorted by ranges and summed up within a range;
    one count per range and 2**bits - 1 values reach the driver.
    """
    n = df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    lined = written(n.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted((r.part, r.n) for r in lined.groupBy("part").agg(F.sum("n").alias("n")).collect())
    start, starts, total = 0, [], sum(c for _, c in sums)
    for part, c in sums:
        starts.append((part, start))
        start += c
    if not total:
        return []
    begins = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long"))  # one row per range
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = lined.join(begins, "part").withColumn("upto", upto)
    step = lambda c: F.floor(c.cast("decimal(20)") * (1 << bits) / F.lit(total).cast("decimal(20)"))
    cut = at.select("v", "upto", F.least(step(F.col("upto")), F.lit((1 << bits) - 1)).alias("b"), step(F.col("upto") - F.col("n")).alias("a")).where("b > a").orderBy("upto")
    return [r.v for r in cut.collect() for _ in range(int(r.a), int(r.b))]


def text_cell(name: str, edges: list) -> Column:
    """Number of cuts under the value."""
    low = sum(e is None for e in edges)
    c, cell = F.col(f"`{name}`"), F.lit(low)
    for e in edges[low:]:
        cell = cell + (c > F.lit(e)).cast("int")
    return F.when(c.isNull(), 0).otherwise(cell).cast("double")


def along_curve(df: DataFrame, dims: list[str], out: str = "curve", bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert index of its quantised ``dims``.

    The driver sees only the cuts: 2**bits - 1 values per dimension. Text is cut by whole values.
    """
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dims if not is_text(df, d)]
    cuts = df.agg(F.lit(0), *[F.percentile_approx(as_number(d), share, 10000).alias(f"c{i}") for i, d in enumerate(numbers)]).first()
    edges = {d: np.array(cuts[i + 1] or []) for i, d in enumerate(numbers)}
    held = [edges.get(d) for d in dims]

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        cells = [c.to_numpy().astype(np.int64) if e is None else np.searchsorted(e, c.to_numpy(), side="left") for e, c in zip(held, cols, strict=True)]
        return pd.Series(curve_index(np.stack(cells, axis=1), bits))

    return df.withColumn(out, index(*[as_number(d) if d in edges else text_cell(d, text_edges(df, d, bits)) for d in dims]))


def cut_runs(df: DataFrame, order: str, ties: list[str], shards: int) -> DataFrame:
    """``df`` with shard and slot: equal runs of the order by ``order`` and ``ties``, sizes at most one apart.

    Rows are range partitioned and sorted once; a row's global place is its
    partition's start plus its place there. Only one count per partition is
    gathered.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    by = [F.col(f"`{c}`") for c in (order, *ties, "__row")]
    lined = written(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "curve")
    counts = sorted((r[0], r[1]) for r in lined.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())
    total, start, starts = sum(n for _, n in counts), 0, []
    for part, n in counts:
        starts.append((part, start))
        start += n
    begins = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))  # one row per partition
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
    shard = F.floor(place * shards / F.lit(max(total, 1))) if total * shards < 1 << 52 else F.expr("(__start + (__at & 8589934591)) * %d div %d" % (shards, total))
    first = F.ceil(F.col("shard") * F.lit(total) / shards)
    lined = lined.withColumn("__part", F.shiftright("__at", 33)).join(begins, "__part")
    return lined.withColumn("__place", place).withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__place") - first).cast("long")).drop("__row", "__at", "__part", "__start", "__place")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows keep the curve's order within a file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
