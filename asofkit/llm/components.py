"""Connected components of a link table by alternating large-star and small-star steps.

Links are first folded to spanning forests inside their partitions, so a group
of n linked rows holds at most n - 1 links per partition from then on. Each
step is a minimum per node (partial before the shuffle) joined back to the
links; the join can be split where a node is hot. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import written


class Forest:
    """Union-find over whatever ids come; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition as stars around their smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                f.join(a, b)
        nodes = [x for x in f.up if f.root(x) != x]
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([f.root(x) for x in part], pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b) but the roots; a root is its component's smallest node."""
    e = written(forest(links).distinct(), "links")
    seen = None
    for _ in range(rounds):
        n, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (n, mark)
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["u"])
        e = written(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct(), "small")
    raise RuntimeError("components did not settle")
