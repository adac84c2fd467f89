"""Gradient boosting of binary outcomes with an offset per row, one model per key, as grouped aggregations.

Rows keep small bin numbers, and a row's node and score follow from them and its
offset. So one tree for all keys together is one aggregation of the rows: gradients
and hessians by (key, bins), partial in every task, so a hot key costs no more than
its rows. All levels of the tree read that table. Splits come from a scan over at
most 256 bins. What moves between steps is the model and the shift of each (key, bins).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import prob as P
from asofkit.session import cut_lineage

SPLIT = "struct<f:int,b:int>"
TREE = f"struct<splits:map<int,{SPLIT}>,leaf:map<int,double>>"


@dataclass(frozen=True)
class Boosting:
    """Settings. ``refresh`` changes nothing: the trees' sum is stored per (key, bins) after every tree."""

    rounds: int = 400
    depth: int = 3
    rate: float = 0.05
    ridge: float = 5.0
    min_rows: int = 200
    refresh: int = 8


def equal_depth_edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Cut points of each feature over all rows: at most ``bins`` - 1 numbers each."""
    share = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.percentile_approx(F.col(f).cast("double"), share, 10000).alias(f) for f in features]).first()
    return {f: sorted(set(got[f] or [])) for f in features}


def binned(edges: dict[str, list[float]]) -> Column:
    """Bin numbers in the order of ``edges``: 0 for a missing value, else one more than the cut points below it."""

    def one(name: str, cuts: list[float]) -> Column:
        # plain comparisons are compiled, a filter over an array is not
        below = sum(((F.col(name).cast("double") > float(c)).cast("int") for c in cuts), F.lit(0))
        return F.when(P.nan_to_null(F.col(name)).isNull(), 0).otherwise(below + 1).cast("int")

    return F.array(*[one(n, c) for n, c in edges.items()])


def _step(node: Column, splits: Column, bins: Column) -> Column:
    s = F.try_element_at(splits, node)
    return node * 2 + F.when(F.get(bins, s["f"]) > s["b"], 1).otherwise(0)


def node_of(splits: Column, bins: Column, levels: int) -> Column:
    """Number of the node a row is in after ``levels`` (the root is 1, children 2i and 2i + 1); where nothing splits, rows go left."""
    node = F.lit(1)
    for _ in range(levels):
        node = _step(node, splits, bins)
    return node


def tree_value(tree: Column, bins: Column, depth: int) -> Column:
    return F.coalesce(F.try_element_at(tree["leaf"], node_of(tree["splits"], bins, depth)), F.lit(0.0))


def raw_score(trees: Column, bins: Column, depth: int) -> Column:
    """Sum of the trees' values in logit space."""
    return F.aggregate(trees, F.lit(0.0), lambda a, t: a + tree_value(t, bins, depth))


def gradients(rows: DataFrame, keys: Sequence[str], bins: str, score: Column, y: Column, *more: Column) -> DataFrame:
    """Sums g, h and n of every (keys, bins): rows with equal bins share the node in every level."""
    p = P.sigmoid(F.col("__score"))
    at = rows.withColumns({"__score": score, "__yy": y})
    return at.groupBy(*keys, bins).agg(F.sum(F.col("__yy") - p).alias("g"), F.sum(p * (1 - p)).alias("h"), F.count(F.lit(1)).alias("n"), *more)


def best_splits(rows: DataFrame, keys: Sequence[str], node: Column, bins: Column, score: Column, y: Column, s: Boosting) -> DataFrame:
    """Best split of every (keys, node): feature index, last bin on the left, sums of both sides and gain; f is null where none helps.

    Ties go to the lower feature and bin.
    """
    at = rows.select(*keys, node.alias("node"), bins.alias("__b"), score.alias("__z"), y.alias("__y"))
    return cell_splits(gradients(at, [*keys, "node"], "__b", F.col("__z"), F.col("__y")), keys, F.col("node"), F.col("__b"), s)


def cell_splits(cells: DataFrame, keys: Sequence[str], node: Column, bins: Column, s: Boosting) -> DataFrame:
    """``best_splits`` from the sums g, h and n of ``gradients``."""
    keys = list(keys)
    # every cell in every feature's histogram: sums are partial in the task that reads the cell
    wide = cells.select(*keys, node.alias("node"), "g", "h", "n", F.posexplode(bins).alias("f", "b"))
    hist = wide.groupBy(*keys, "node", "f", "b").agg(*[F.sum(c).alias(c) for c in "ghn"])
    w = Window.partitionBy(*keys, "node", "f")
    upto = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(*keys, "node", "f", "b", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(w).alias(f"{c}t") for c in "ghn"])
    cum = cum.withColumns({f"{c}r": F.col(f"{c}t") - F.col(f"{c}l") for c in "ghn"})
    part = lambda x: F.col(f"g{x}") * F.col(f"g{x}") / (F.col(f"h{x}") + s.ridge)
    gain = F.round(part("l") + part("r") - part("t"), 9)
    ok = (F.col("nl") >= s.min_rows) & (F.col("nr") >= s.min_rows) & (gain > 0)
    pick = F.when(ok, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "gl", "hl", "gr", "hr"))
    best = cum.groupBy(*keys, "node").agg(F.max(pick).alias("s"), F.max_by(F.struct("gt", "ht"), F.struct(-F.col("f"), -F.col("b"))).alias("t"))
    return best.select(*keys, "node", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b"), "s.gain", F.coalesce("s.gl", "t.gt").alias("gl"), F.coalesce("s.hl", "t.ht").alias("hl"),
                       F.coalesce("s.gr", F.lit(0.0)).alias("gr"), F.coalesce("s.hr", F.lit(0.0)).alias("hr"))


def boosted(rows: DataFrame, keys: Sequence[str], bins: str, offset: str, y: str, s: Boosting, written: bool = False) -> DataFrame:
    """(keys, trees) fitted on ``rows`` with the log-odds ``offset`` held fixed; leaves are Newton steps times the rate.

    ``written``: the rows are a table already.
    """
    keys = list(keys)
    rows = rows.select(*keys, bins, F.col(offset).cast("double").alias("__z"), F.col(y).cast("double").alias("__y"))
    rows = rows if written else cut_lineage(rows)
    model, shift = None, None
    for t in range(s.rounds):
        at = rows.withColumn("__s", F.lit(0.0)) if shift is None else rows.join(shift, [*keys, bins])
        cells = cut_lineage(gradients(at, keys, bins, F.col("__z") + F.col("__s"), F.col("__y"), F.first("__s").alias("__s")))
        if model is None:
            model = cut_lineage(cells.select(*keys).distinct().withColumn("trees", F.array().cast(f"array<{TREE}>")))
        grown = model.select(*keys, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast(f"array<{SPLIT}>")).alias("splits"))
        for level in range(s.depth):
            found = cell_splits(cells.join(grown, keys), keys, node_of(F.col("splits"), F.col(bins), level), F.col(bins), s)
            cut = F.map_from_entries(F.filter(F.collect_list(F.struct("node", F.when(F.col("f").isNotNull(), F.struct("f", "b")).alias("s"))), lambda e: e["s"].isNotNull()))
            value = lambda side: s.rate * F.col(f"g{side}") / (F.col(f"h{side}") + s.ridge)
            leaves = F.map_from_entries(F.flatten(F.collect_list(F.array(F.struct(F.col("node") * 2, value("l")), F.struct(F.col("node") * 2 + 1, value("r"))))))
            new = found.groupBy(*keys).agg(cut.cast(f"map<int,{SPLIT}>").alias("cut"), leaves.alias("leaf"))  # 2 ** depth nodes at most
            grown = grown.join(new, keys).withColumn("splits", F.map_concat("splits", "cut"))
            if level == s.depth - 1:
                grown = grown.withColumn("tree", F.struct("splits", "leaf").cast(TREE))
            grown = cut_lineage(grown.drop("cut", "leaf"))
        add = grown.select(*keys, "tree")
        model = cut_lineage(model.join(add, keys).withColumn("trees", F.array_append("trees", F.col("tree"))).drop("tree"))
        if t < s.rounds - 1:
            shift = cut_lineage(cells.join(add, keys).select(*keys, bins, (F.col("__s") + tree_value(F.col("tree"), F.col(bins), s.depth)).alias("__s")))
    return model if model is not None else rows.select(*keys).distinct().withColumn("trees", F.array().cast(f"array<{TREE}>"))


def _of_bins(rows: DataFrame, model: DataFrame, keys: Sequence[str], bins: str, value: Column, out: str) -> DataFrame:
    """(keys, bins, out): ``value`` of the model, once for each combination of bins and not for each row."""
    return cut_lineage(rows.select(*keys, bins).distinct().join(model, list(keys)).select(*keys, bins, value.alias(out)))


def best_rounds(rows: DataFrame, model: DataFrame, keys: Sequence[str], bins: str, offset: str, y: str, depth: int) -> DataFrame:
    """(keys, n_holdout, best_iter, ll_base, ll_head): the number of trees with the least loss on ``rows``, the first of equals, in one pass."""
    keys = list(keys)
    run = F.aggregate(F.col("trees"), F.array(F.lit(0.0)), lambda acc, t: F.array_append(acc, F.element_at(acc, -1) + tree_value(t, F.col(bins), depth)))
    at = rows.select(*keys, bins, F.col(offset).cast("double").alias("__z"), F.col(y).alias("y")).join(_of_bins(rows, model, keys, bins, run, "__run"), [*keys, bins])
    long = at.select(*keys, "y", "__z", F.posexplode("__run").alias("trees", "__s")).withColumn("__p", P.sigmoid(F.col("__z") + F.col("__s")))
    ll = long.groupBy(*keys, "trees").agg(F.count(F.lit(1)).alias("n"), F.avg(P.log_loss("y", "__p")).alias("ll"))
    fitted = F.struct(F.round("ll", 12).alias("r"), "trees", "ll")
    return ll.groupBy(*keys).agg(F.max("n").alias("n_holdout"), F.min(F.when(F.col("trees") > 0, fitted)).alias("best"), F.max(F.when(F.col("trees") == 0, F.col("ll"))).alias("ll_base")).select(
        *keys, "n_holdout", F.col("best.trees").alias("best_iter"), "ll_base", F.col("best.ll").alias("ll_head"))


def apply_heads(rows: DataFrame, heads: DataFrame, keys: Sequence[str], bins: str, p: str, depth: int, out: str = "p_head") -> DataFrame:
    """``rows`` with the heads' shift in logit space where their held-out ``gain`` is positive, else ``p``.

    ``heads``: keys, trees, best_iter, gain.
    """
    keys = list(keys)
    use = heads.filter("gain > 0").select(*keys, F.slice("trees", F.lit(1), F.col("best_iter")).alias("__trees"))
    shift = _of_bins(rows, use, keys, bins, raw_score(F.col("__trees"), F.col(bins), depth), "__s")
    shifted = P.clip(P.sigmoid(P.logit(p) + F.col("__s")), 1e-6, 1 - 1e-6)
    return rows.join(shift, [*keys, bins], "left").select(*rows.columns, F.when(F.col("__s").isNull(), F.col(p)).otherwise(shifted).alias(out))


def residual_heads(led: DataFrame, family: str, date: str, p: str, y: str, edges: dict[str, list[float]], s: Boosting, holdout: float = 0.25, least: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Heads (family, trees, best_iter, gain) and their report, each fitted on the first days of its family and measured on the last ``holdout`` of them.

    A family with fewer than ``least`` rows or one outcome is skipped and reported so.
    """
    from asofkit.operators.evaluation import slate_index

    days = slate_index(led, [family], date)
    cut = days.filter(F.col("i") == F.floor(F.col("n_dates") * (1 - holdout))).select(family, F.col(date).alias("__cut"))
    size = led.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(y).alias("__k"))
    fit = size.join(cut, family, "left").withColumn("fits", (F.col("n") >= least) & (F.col("__k") > 1) & F.col("__cut").isNotNull())
    fit = cut_lineage(fit.select(family, "n", "fits", "__cut"))
    rows = led.join(fit.filter("fits").select(family, "__cut"), family)
    rows = cut_lineage(rows.select(family, binned(edges).alias("bins"), P.logit(p).alias("z"), F.col(y).cast("int").alias("y"), (F.col(date) >= F.col("__cut")).alias("late")))
    model = boosted(rows.filter("NOT late"), [family], "bins", "z", "y", s, written=True)
    found = best_rounds(rows.filter("late"), model, [family], "bins", "z", "y", s.depth)
    found = cut_lineage(found.withColumn("gain", F.col("ll_base") - F.col("ll_head")))
    heads = model.join(found.select(family, "best_iter", "gain"), family)
    moved = apply_heads(rows.filter("late").withColumn("p", P.sigmoid("z")), heads.withColumn("gain", F.lit(1.0)), [family], "bins", "p", s.depth).groupBy(family).agg(F.max(F.abs(F.col("p_head") - F.col("p"))).alias("max_adj"))
    status = F.when(~F.col("fits"), "skipped").when(F.col("gain") > 0, "active").otherwise("identity")
    return heads, fit.select(family, "n", "fits").join(found, family, "left").join(moved, family, "left").withColumn("status", status).drop("fits")
