"""Merkle manifest of a dataset: a postorder append log per tree, and proofs addressed by closed-form positions.

Each row is a leaf; leaves of one group (``tree``) ascend by a given order and
pair up level by level, an odd last node alone, until one is left; those roots
form one more tree in the order of their group. Aligned builders take runs of
``1 << BITS`` leaves and append nodes in the order in which they are complete: a
leaf, then every node that it completes. The roots of the runs are the leaves
of the next round, so a tree of n leaves takes log n / BITS rounds and no task
holds more than one run.

A node over the leaves up to ``e`` at level ``l`` is the log's entry
``2 * e - popcount(e) + l``: before leaf e come e leaves and e - popcount(e)
finished inner nodes. This holds for an incomplete last run too, because its
unfinished nodes end with its last leaf. Runs start at multiples of their
length, so the same formula addresses a node inside its run's segment, and
proofs read siblings at computed places without a search.

Cases: null fields hash as ``-``; a null group is a group of its own that comes
first; rows with equal order and equal leaf are interchangeable (each is a leaf);
a group of one row has its leaf as root; an empty table gives no rows; other
columns are kept by ``proofs``; columns named subroot, root or steps give way to
its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.llm.common import fresh, written
from asofkit.llm.order import ranked

#: Levels of one builder: a run has 1 << BITS leaves.
BITS = 11


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Hash of fields, each as ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def position(e: int, level: int) -> int:
    """Place in the log of the node at ``level`` whose last leaf is ``e``."""
    return 2 * e - e.bit_count() + level


def height(n: int) -> int:
    return max(n - 1, 0).bit_length()


def joined(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def segment(leaves: list[str], levels: int) -> list[str]:
    """The nodes over a run of leaves in completion order; the last is the run's root at ``levels``."""
    log: list[str] = []
    open_: list[str | None] = [None] * (levels + 1)  # a left child that waits, per level
    for i, node in enumerate(leaves):
        log.append(node)
        last = i == len(leaves) - 1
        for level in range(levels):
            if (i >> level) & 1:
                node = joined(open_[level], node)
            elif last:
                node = joined(node)
            else:
                open_[level] = node
                break
            log.append(node)
    return log


def siblings(log: list[str], i: int, m: int, levels: int) -> list[str]:
    """Steps from leaf ``i`` of a run of ``m`` to its root: L or R and the sibling, empty where a node is alone."""
    out = []
    for level in range(levels):
        j = (i >> level) ^ 1
        if j > (m - 1) >> level:
            out.append("")
        else:
            e = min((j + 1) << level, m) - 1
            out.append(("L" if j < i >> level else "R") + log[position(e, level)])
    return out


def fold(node: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    side, other = (lambda s: F.substring(s, 1, 1)), (lambda s: F.substring(s, 2, 64))
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.when(side(s) == "L", F.concat(other(s), acc)).otherwise(F.concat(acc, other(s))), 256))


def proof_digest(steps: Column) -> Column:
    """Hash of the siblings of a path, leaf to root."""
    return digest(F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64)), ""))


LOG = T.StructType([T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("nodes", T.BinaryType()), T.StructField("root", T.StringType())])


def append_log(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Rounds of log segments over ``nodes`` (tree, rank, n, node): one row per run, nodes as joined raw digests.

    Every round is written before the next reads its roots.
    """

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        n = t["n"][0].as_py()
        log = segment(t["node"].to_pylist(), min(bits, height(n)))
        return pa.table([[t["tree"][0].as_py()], [t["block"][0].as_py()], [n], [bytes.fromhex("".join(log))], [log[-1]]], schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("root", pa.string())]))

    rounds = []
    while True:
        rounds.append(written(nodes.select("tree", F.shiftright("rank", bits).alias("block"), "rank", "n", "node").groupBy("tree", "block").applyInArrow(build, LOG), "log"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= 1 << bits:
            return rounds
        nodes = rounds[-1].select("tree", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.col("root").alias("node"))


def paths(rows: DataFrame, log: DataFrame, upper: DataFrame | None, bits: int, extra: list[str] = []) -> DataFrame:
    """``rows`` (tree, rank and others) with the steps of each leaf through its run, then those of the run's root.

    ``upper`` has tree, rank (of the run) and steps; ``extra`` are text columns of ``log`` to
    hand on. Rows meet their one segment by (tree, block).
    """
    if upper is None:
        log = log.withColumn("above", F.array().cast("array<string>"))
    else:
        log = log.join(upper.select("tree", F.col("rank").alias("block"), F.col("steps").alias("above")), ["tree", "block"])
    block = fresh("block", [*rows.columns, "steps", *extra])
    out = T.StructType([*rows.schema.fields, T.StructField("steps", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in extra]])

    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, above = right["nodes"][0].as_py().hex(), right["above"][0].as_py()
        entries = [raw[i : i + 64] for i in range(0, len(raw), 64)]
        levels, ranks = min(bits, height(right["n"][0].as_py())), left["rank"].to_pylist()
        got = [siblings(entries, r & ((1 << bits) - 1), len(ranks), levels) + above for r in ranks]
        left = left.drop_columns([block]).append_column("steps", pa.array(got, pa.list_(pa.string())))
        for c in extra:
            left = left.append_column(c, pa.array([right[c][0].as_py()] * len(ranks), pa.string()))
        return left

    keyed = rows.withColumn(block, F.shiftright("rank", bits))
    return keyed.groupBy("tree", block).cogroup(log.groupBy("tree", "block")).applyInArrow(extract, out)


def climbed(rows: DataFrame, rounds: list[DataFrame], upper: DataFrame | None, bits: int, extra: list[str] = []) -> DataFrame:
    """``rows`` with their steps through all rounds of the log, from the last round down."""
    for below, here in zip(rounds[-2::-1], rounds[:0:-1], strict=True):
        runs = below.select("tree", F.col("block").alias("rank"))
        upper = written(paths(runs, here, upper, bits), "steps")
    return paths(rows, rounds[0], upper, bits, extra)


def proofs(df: DataFrame, tree: str, order: list[str], node: str, bits: int = BITS) -> DataFrame:
    """``df`` with subroot, root and steps (leaf to root) of every row; column ``node`` holds the leaf's hash."""
    df = df.drop("subroot", "root", "steps")
    own = {c: fresh(f"own_{i}", df.columns) for i, c in enumerate(df.columns)}
    inner = df.select(*[F.col(f"`{c}`").alias(own[c]) for c in df.columns], F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("")).alias("tree"))
    leaves = written(ranked(inner, "tree", [*[F.col(own[c]).asc_nulls_first() for c in order], F.col(own[node]).asc()], "rank", "n"), "leaves")
    rounds = append_log(leaves.select("tree", "rank", "n", F.col(own[node]).alias("node")), bits)
    # the roots of all groups, in the order of the groups, are the leaves of one more tree
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"))
    tops = written(ranked(tops, "tree", [F.col("of").asc()], "rank", "n"), "tops")
    above = append_log(tops, bits)
    top = climbed(tops, above, None, bits).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("rank"), "steps", F.col("node").alias("subroot"))
    top = written(top, "top")
    rounds[0] = rounds[0].drop("root").join(top.select("tree", "subroot"), "tree")
    root = above[-1].select("root").first()
    got = climbed(leaves, rounds, top.drop("subroot"), bits, ["subroot"])
    return got.select(*[F.col(own[c]).alias(c) for c in df.columns], "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "steps")
