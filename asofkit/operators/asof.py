"""Decayed panels and as-of joins.

Everything runs at (entity, date) grain: rows are aggregated to days first, so a
window over one entity holds at most two rows per calendar day however many raw
rows the entity has. The result goes back to the raw rows by an equi join on
(entity, date), which adaptive execution can split when a key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.scan import Carry, ordered_scan


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def decayed_panel(
    daily: DataFrame, entity: Sequence[str], stats: Sequence[str], half_life: float, date: str = "d", suffix: str = "_d"
) -> DataFrame:
    """Decayed sums through each active date: sum over u<=t of x_u * 2^-((t-u)/hl).

    ``daily`` holds one row per (entity, date). The exponent restarts at the
    entity's first day so it stays small.
    """
    we = Window.partitionBy(*entity)
    w = we.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    t = F.datediff(F.col(date), F.col("__first")) / F.lit(float(half_life))
    src = daily.filter(F.col(date).isNotNull())
    for e in entity:
        src = src.filter(F.col(e).isNotNull())
    src = src.withColumn("__first", F.min(date).over(we)).withColumn("__t", t)
    return src.select(
        *entity,
        date,
        *[
            (F.sum(F.coalesce(F.col(s).cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), F.col("__t"))).over(w)
             * F.pow(F.lit(2.0), -F.col("__t"))).alias(s + suffix)
            for s in stats
        ],
    )


def asof_join(
    left: DataFrame,
    panel: DataFrame,
    entity: Sequence[str],
    stats: Sequence[str],
    *,
    date: str = "d",
    panel_date: str | None = None,
    strict: bool = True,
    direction: str = "backward",
    tolerance_days: int | None = None,
    offset_days: int = 0,
    half_life: float | None = None,
    match_date: str | None = None,
    strategy: str = "window",
) -> DataFrame:
    """Left as-of join at day grain; ``panel`` has one row per (entity, date).

    ``strict`` uses only panel rows before (after, for forward) the row's date
    shifted back by ``offset_days``. ``half_life`` ages the stats from the panel
    date to the row date. ``match_date`` names an output column for the date used.
    ``strategy='range'`` answers with validity intervals instead of a union; both
    give the same rows.
    """
    entity = list(entity)
    pd_ = panel_date or date
    probe = F.date_sub(F.col(date), offset_days) if offset_days else F.col(date)
    ok = F.col("__q").isNotNull()
    for e in entity:
        ok = ok & F.col(e).isNotNull()
    asks = left.select(*entity, probe.alias("__q")).filter(ok).distinct()
    rows = panel.select(*entity, F.col(pd_).alias("__q"), F.struct(F.col(pd_).alias("__pd"), *stats).alias("__hit"))
    rows = rows.filter(ok)
    back = direction == "backward"

    if strategy == "range":
        step = F.lead if back else F.lag
        w = Window.partitionBy(*entity).orderBy("__q")
        iv = rows.withColumn("__edge", step("__q").over(w)).select(
            *entity, F.col("__q").alias("__p"), "__edge", "__hit"
        )
        q, p, e = F.col("__q"), F.col("__p"), F.col("__edge")
        if back:
            cond = ((q > p) & (e.isNull() | (q <= e))) if strict else ((q >= p) & (e.isNull() | (q < e)))
        else:
            cond = ((q < p) & (e.isNull() | (q >= e))) if strict else ((q <= p) & (e.isNull() | (q > e)))
        spine = asks.join(iv, entity).filter(cond).select(*entity, "__q", "__hit")
    else:
        # A question sorts before a panel row of the same day when that row must stay invisible.
        q_side, p_side = (0, 1) if strict else (1, 0)
        both = asks.withColumn("__side", F.lit(q_side)).unionByName(
            rows.withColumn("__side", F.lit(p_side)), allowMissingColumns=True
        )
        # Looking forward is looking backward in reverse order (a growing frame, not a shrinking one).
        w = Window.partitionBy(*entity).orderBy(F.col("__q").asc() if back else F.col("__q").desc(), "__side")
        hit = F.last("__hit", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        spine = both.withColumn("__m", hit).filter(F.col("__side") == q_side).select(
            *entity, "__q", F.col("__m").alias("__hit")
        )

    out = left.withColumn("__q", probe).join(spine, entity + ["__q"], "left")
    pdate = F.col("__hit")["__pd"]
    gap = F.datediff(F.col("__q"), pdate) if back else F.datediff(pdate, F.col("__q"))
    keep = gap <= tolerance_days if tolerance_days is not None else F.lit(True)
    age = F.datediff(F.col(date), pdate)
    cols = []
    for s in stats:
        v = F.col("__hit")[s]
        if half_life:
            v = v * F.pow(F.lit(2.0), -age / F.lit(float(half_life)))
        cols.append(F.when(keep, v).alias(s) if tolerance_days is not None else v.alias(s))
    if match_date:
        cols.append(F.when(keep, pdate).alias(match_date))
    return out.select(*[c for c in left.columns], *cols)


def multi_panel_asof(
    left: DataFrame,
    entity: Sequence[str],
    panels: dict[str, tuple[DataFrame, Sequence[str], float]],
    date: str = "d",
) -> DataFrame:
    """Several strictly-before decayed as-of joins on one entity key in one window pass.

    ``panels`` maps a name to (panel, stats, half-life). One shuffle for the union
    and one for the way back, whatever the number of panels.
    """
    entity = list(entity)
    ok = F.col(date).isNotNull()
    for e in entity:
        ok = ok & F.col(e).isNotNull()
    union = left.select(*entity, date).filter(ok).distinct().withColumn("__side", F.lit(0))
    for name, (panel, stats, _) in panels.items():
        rows = panel.filter(ok).select(
            *entity, date, F.lit(1).alias("__side"), F.struct(F.col(date).alias("__pd"), *stats).alias(f"__h_{name}")
        )
        union = union.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*entity).orderBy(date, "__side").rowsBetween(Window.unboundedPreceding, 0)
    spine = union.select(
        *entity, date, "__side", *[F.last(f"__h_{n}", True).over(w).alias(f"__h_{n}") for n in panels]
    ).filter("__side = 0")
    out = left.join(spine.drop("__side"), entity + [date], "left")
    cols = []
    for name, (_, stats, hl) in panels.items():
        h = F.col(f"__h_{name}")
        f = F.pow(F.lit(2.0), -F.datediff(F.col(date), h["__pd"]) / F.lit(float(hl)))
        cols += [(h[s] * f).alias(f"{name}_{s}") for s in stats]
    return out.select(*left.columns, *cols)


def asof_time_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    *,
    ts: str = "ts",
    strict: bool = True,
    chunk: Column | None = None,
) -> DataFrame:
    """Backward as-of join at timestamp grain: newest right row at/before each left row.

    Uses the chunked scan (a day by default), so no key is gathered in one task.
    Equal times on the right must be broken before the call.
    """
    key = list(key)
    q_side, p_side = (0, 1) if strict else (1, 0)
    li = left.withColumn("__side", F.lit(q_side))
    ri = right.select(*key, F.col(ts), F.struct(F.col(ts).alias("__pt"), *cols).alias("__r")).withColumn(
        "__side", F.lit(p_side)
    )
    both = li.unionByName(ri, allowMissingColumns=True)
    done = ordered_scan(
        both, key, [F.col(ts), F.col("__side")], chunk if chunk is not None else F.to_date(ts),
        [Carry("__m", F.col("__r"))],
    ).filter(F.col("__side") == q_side)
    return done.select(*left.columns, F.col("__m")["__pt"].alias("match_ts"), *[F.col("__m")[c].alias(c) for c in cols])


def audit_leakage(rows: DataFrame, date: str, match_date: str) -> DataFrame:
    """Counts of rows whose feature date is not strictly earlier than the row date."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col(match_date).isNull(), 1).otherwise(0)).cast("long").alias("n_no_history"),
        F.sum(F.when(F.col(match_date) >= F.col(date), 1).otherwise(0)).cast("long").alias("n_leaks"),
    )

