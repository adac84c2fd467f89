"""Guarded joins: fallbacks, ambiguity checks, ordinals, intervals, entity resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import text as T
from asofkit.operators.asof import asof_time_join
from asofkit.operators.scan import Following, Index, Previous, Total, ordered_scan, pick_one


def dot_product(
    rows: DataFrame, usage: DataFrame, value: DataFrame, usage_key: Sequence[str], value_key: Sequence[str], kind: str,
    u: str, v: str, out: str, n_out: str,
) -> DataFrame:
    """Sum over kinds of usage * value for each row; NULL when no kind is on both sides.

    ``kind`` comes from a small vocabulary, so each side folds into one map per key.
    """
    um = usage.groupBy(*usage_key).agg(F.map_from_entries(F.collect_list(F.struct(kind, u))).alias("__u"))
    vm = value.groupBy(*value_key).agg(F.map_from_entries(F.collect_list(F.struct(kind, v))).alias("__v"))
    j = rows.join(um, list(usage_key), "left").join(vm, list(value_key), "left")
    both = F.filter(F.map_keys("__u"), lambda k: F.map_contains_key(F.col("__v"), k))
    total = F.aggregate(both, F.lit(0.0), lambda a, k: a + F.element_at("__u", k) * F.element_at("__v", k))
    return j.withColumn(n_out, F.coalesce(F.greatest(F.size(both), F.lit(0)), F.lit(0))).withColumn(
        out, F.when(F.col(n_out) > 0, total)).drop("__u", "__v")


def guarded_lookup(left: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Left equi join after reducing the dimension to one row per key, so rows never multiply."""
    one = pick_one(dim, keys, order).select(*keys, *cols)
    return left.join(one, list(keys), "left")


def fallback_lookup(
    left: DataFrame, dim: DataFrame, keys: Sequence[str], exact: str, value: str, sentinel: Column | None = None
) -> DataFrame:
    """Value under the exact key, else under the sentinel (NULL) key.

    The sentinel answers only when the group has no exact rows and the left rows of
    that key name at most one exact id (otherwise it could be either one).
    """
    keys = list(keys)
    blank = F.col(exact).isNull() if sentinel is None else sentinel
    ex = dim.filter(~blank).select(*keys, exact, F.col(value).alias("__x"))
    sent = dim.filter(blank).select(*keys, F.col(value).alias("__s"))
    has = dim.filter(~blank).select(*keys).distinct().withColumn("__has", F.lit(True))
    ids = left.filter(F.col(exact).isNotNull()).groupBy(*keys).agg(F.countDistinct(exact).alias("__ids"))
    j = (left.join(ex, [*keys, exact], "left").join(sent, keys, "left").join(has, keys, "left").join(ids, keys, "left"))
    alone = F.col("__has").isNull() & (F.coalesce("__ids", F.lit(0)) <= 1)
    return j.withColumn(value, F.coalesce("__x", F.when(alone, F.col("__s")))).withColumn(
        f"{value}_via", F.when(F.col("__x").isNotNull(), "exact").when(alone & F.col("__s").isNotNull(), "sentinel")
    ).drop("__x", "__s", "__has", "__ids")


def drop_stale_sentinels(df: DataFrame, keys: Sequence[str], exact: str) -> DataFrame:
    """Remove sentinel (NULL id) rows of every key that also has rows with an id."""
    keyed = df.filter(F.col(exact).isNotNull()).select(*keys).distinct()
    return df.filter(F.col(exact).isNotNull()).unionByName(
        df.filter(F.col(exact).isNull()).join(keyed, list(keys), "left_anti"))


def nearest_guarded(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_ts: str, right_ts: str, right_id: str,
    max_hours: float = 6.0, tie_minutes: float = 5.0,
) -> DataFrame:
    """Id of the nearest right event of the same key; NULL when nothing is near or two are tied.

    A single candidate must lie within ``max_hours``. With several, the nearest wins only
    when it is more than ``tie_minutes`` closer than the runner-up. Candidates are looked
    for in time order: the two rows on either side are enough to know the nearest two.
    """
    keys = list(keys)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = right.groupBy(*keys, micros(right_ts).alias("__t")).agg(
        F.min(right_id).alias("id"), F.count(F.lit(1)).alias("c"))
    total = events.groupBy(*keys).agg(F.sum("c").alias("__n"))
    month = F.floor(F.col("__t") / F.lit(30 * 86400 * 1000000))
    me = F.struct("__t", "id", "c")
    events = ordered_scan(events, keys, [F.col("__t")], month, [Previous("before", me), Following("after", me)])
    events = events.withColumn("me", me).withColumn("__neg", -F.col("__t"))
    ask = left.select(*keys, left_id, micros(left_ts).alias("__t")).withColumn("__neg", -F.col("__t"))
    ask = asof_time_join(ask, events.select(*keys, "__t", "me", "before"), keys, ["me", "before"], ts="__t", strict=False,
                         chunk=month).withColumnsRenamed({"me": "p1", "before": "p2"}).drop("match_ts")
    ask = asof_time_join(ask, events.select(*keys, "__neg", "me", "after"), keys, ["me", "after"], ts="__neg", strict=True,
                         chunk=F.floor(F.col("__neg") / F.lit(30 * 86400 * 1000000))).join(total, keys, "left")
    near = F.filter(F.array("p1", "p2", "me", "after"), lambda c: c.isNotNull())
    gaps = F.array_sort(F.transform(near, lambda c: F.struct(F.abs(c["__t"] - F.col("__t")).alias("g"), c["id"].alias("id"), c["c"].alias("c"))))
    best, second = F.get(gaps, F.lit(0)), F.get(gaps, F.lit(1))
    clear = (best["c"] == 1) & (best["g"] + F.lit(int(tie_minutes * 6e7)) < second["g"])
    ok = F.when(F.col("__n") == 1, best["g"] <= F.lit(int(max_hours * 3.6e9))).otherwise(clear)
    return left.join(ask.select(left_id, F.when(ok, best["id"]).alias(f"{right_id}_match")), left_id, "left")


def ordinal_pair(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column],
    chunk_left: Column, chunk_right: Column, cols: Sequence[str],
) -> DataFrame:
    """k-th left row with k-th right row of a key, only when both sides have the same count.

    ``status`` says paired, unequal (refused) or no_right.
    """
    keys = list(keys)
    one = F.lit(1)
    li = ordered_scan(left, keys, left_order, chunk_left, [Index("ord"), Total("__nl", one)])
    ri = ordered_scan(right, keys, right_order, chunk_right, [Index("ord")])
    counts = right.groupBy(*keys).agg(F.count(one).alias("__nr"))
    j = li.join(counts, keys, "left").join(ri.select(*keys, "ord", *cols), [*keys, "ord"], "left")
    same = F.col("__nl") == F.col("__nr")
    status = F.when(F.col("__nr").isNull(), "no_right").when(same, "paired").otherwise("unequal")
    return j.select(*left.columns, "ord", status.alias("status"), *[F.when(same, F.col(c)).alias(c) for c in cols])


def interval_active(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], date: str, start: str, end: str, horizon: str | None = None
) -> DataFrame:
    """Flag points that fall in [start, end) of an interval of their key; open ends allowed.

    Intervals of a key that start on the same day are folded to the longest, so a key has at most one
    per day; they are cut into months and joined by (key, month), an equi join however long an
    interval or however hot a key.
    """
    keys = list(keys)
    top = points.agg(F.max(date)).scalar()
    iv = intervals.select(*keys, start, end).filter(F.col(start).isNotNull()).withColumn(
        "__end", F.coalesce(F.col(end), F.date_add(top, 1)))
    # of intervals with the same start the longest covers the others
    iv = iv.filter(F.col("__end") > F.col(start)).groupBy(*keys, start).agg(F.max("__end").alias("__end"))
    iv = iv.withColumn("__m", F.explode(F.sequence(
        F.trunc(start, "month"), F.trunc("__end", "month"), F.expr("interval 1 month"))))
    asks = points.select(*keys, date).distinct().withColumn("__m", F.trunc(date, "month"))
    hit = asks.join(iv, [*keys, "__m"]).filter((F.col(start) <= F.col(date)) & (F.col(date) < F.col("__end")))
    hit = hit.groupBy(*keys, date).agg(F.max(start).alias("active_since"))
    return points.join(hit, [*keys, date], "left")


def exact_lag(left: DataFrame, daily: DataFrame, keys: Sequence[str], date: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Value exactly ``lag`` days earlier (0 when there is none), one equi join per lag."""
    out = left
    for k in lags:
        r = daily.select(*keys, F.date_add(date, k).alias(date), F.col(value).alias(f"{value}_lag{k}"))
        out = out.join(r, [*keys, date], "left")
    return out.fillna(0, subset=[f"{value}_lag{k}" for k in lags])


def perspective(df: DataFrame, is_home: Column, names: Sequence[str]) -> list[Column]:
    """own_x / opp_x columns from home_x and away_x."""
    out = []
    for c in names:
        h, a = F.col(f"home_{c}"), F.col(f"away_{c}")
        out += [F.when(is_home, h).otherwise(a).alias(f"own_{c}"), F.when(is_home, a).otherwise(h).alias(f"opp_{c}")]
    return out


def slot_means(
    rows: DataFrame, row_id: str, groups: dict[str, Sequence[str]], dim: DataFrame, dim_key: str, value: str
) -> DataFrame:
    """Look up several id columns in one dimension and average by group, ignoring missing ones."""
    slots = [(g, c) for g, cs in groups.items() for c in cs]
    long = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(c).cast("long").alias("id")) for g, c in slots])).alias("s"))
    long = long.select(row_id, "s.g", F.col("s.id").alias(dim_key)).join(dim.select(dim_key, value), dim_key, "left")
    means = long.groupBy(row_id).agg(*[F.avg(F.when(F.col("g") == g, F.col(value))).alias(g) for g in groups])
    return rows.join(means, row_id, "left")


def _name_keys(df: DataFrame, name: str, strip: bool) -> DataFrame:
    n = T.norm_name(T.strip_position(F.col(name)) if strip else F.col(name))
    df = df.withColumn("__n", n).filter(F.col("__n") != "")
    return df.withColumn("__c", T.collapsed("__n")).withColumn("__l", T.last_name("__n")).withColumn("__i", T.first_initial("__n"))


def _name_tiers(asks: DataFrame, idx: DataFrame, tiers, entity: str, latest: str) -> DataFrame:
    """One left join per tier (label, ask columns, index columns, exact). An exact tier answers with the latest
    entry; the looser ones only with exactly one id, told by the minimum and maximum of partial aggregations."""
    out = asks
    for k, (_, ours, theirs, exact) in enumerate(tiers):
        pick = F.max_by(entity, F.struct(latest, entity)) if exact else F.when(F.min(entity) == F.max(entity), F.min(entity))
        found = idx.groupBy(*[F.col(t).alias(f"__k{i}") for i, t in enumerate(theirs)]).agg(pick.alias(f"__t{k}")).filter(F.col(f"__t{k}").isNotNull())
        on = [out[o] == found[f"__k{i}"] for i, o in enumerate(ours)]
        out = out.join(found, on, "left").drop(*[f"__k{i}" for i in range(len(ours))])
    return out


def resolve_entities(asks: DataFrame, index: DataFrame, ask_id: str, team: str, name: str, entity: str, latest: str | None = None) -> DataFrame:
    """Entity id for a name by ever looser keys.

    Tiers: exact name in team (the latest by ``latest``, the id if not given), collapsed in team, exact
    name anywhere, collapsed anywhere, last name with first initial in team.
    """
    idx, q = _name_keys(index, name, False), _name_keys(asks, name, True)
    keys = [("exact", [team, "__n"]), ("team_collapsed", [team, "__c"]), ("name", ["__n"]), ("collapsed", ["__c"]), ("initial", [team, "__l", "__i"])]
    out = _name_tiers(q, idx, [(t, k, k, t == "exact") for t, k in keys], entity, latest or entity)
    via = F.coalesce(*[F.when(F.col(f"__t{i}").isNotNull(), t) for i, (t, _) in enumerate(keys)])
    found = out.select(ask_id, F.coalesce(*[f"__t{i}" for i in range(len(keys))]).alias(entity), via.alias("tier"))
    return asks.join(found, ask_id, "left")


def resolve_for_clubs(asks: DataFrame, index: DataFrame, ask_id: str, clubs: Sequence[str], team: str, name: str, entity: str, latest: str | None = None) -> DataFrame:
    """Entity and club of a name that may belong to any of the ask's ``clubs`` (columns, in order of trust).

    Per club: exact, collapsed, last name with first initial; a hit names the club. A name that is
    unique anywhere still gives the entity, with no club.
    """
    idx, q = _name_keys(index, name, False), _name_keys(asks, name, True)
    tiers, owner = [], []
    for c in clubs:
        for label, k in (("exact", ["__n"]), ("team_collapsed", ["__c"]), ("initial", ["__l", "__i"])):
            tiers.append((label, [c, *k], [team, *k], label == "exact"))
            owner.append(F.col(c))
    for label, k in (("name", ["__n"]), ("collapsed", ["__c"])):
        tiers.append((label, k, k, False))
        owner.append(F.lit(None))
    out = _name_tiers(q, idx, tiers, entity, latest or entity)
    hit = [F.col(f"__t{i}").isNotNull() for i in range(len(tiers))]
    first = lambda values: F.coalesce(*[F.when(h & ~_any(hit[:i]), v) for i, (h, v) in enumerate(zip(hit, values, strict=True))])
    found = out.select(ask_id, F.coalesce(*[f"__t{i}" for i in range(len(tiers))]).alias(entity), first(owner).alias("club"), first([F.lit(t[0]) for t in tiers]).alias("tier"))
    return asks.join(found, ask_id, "left")


def _any(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def merge_sources(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer join, then each column from the second source where the first has none."""
    f = fallback.select(*keys, *[F.col(c).alias(f"__f_{c}") for c in cols])
    j = primary.join(f, list(keys), "full_outer")
    return j.select(*keys, *[F.coalesce(F.col(c), F.col(f"__f_{c}")).alias(c) for c in cols])


def two_hop(rows: DataFrame, first: DataFrame, second: DataFrame, label: str, stable: str, season: str, out: str) -> DataFrame:
    """Current label -> stable id -> that season's label; ``unmapped`` marks rows without one."""
    j = rows.join(first.select(label, stable), label, "left").join(
        second.select(stable, season, F.col(label).alias(out)), [stable, season], "left")
    return j.withColumn("unmapped", F.col(out).isNull())


def first_claimant(rows: DataFrame, group: Sequence[str], slot: str, order: Sequence[Column], entity: str,
                   slots: Sequence[str]) -> DataFrame:
    """First entity in order claims each slot; one column per slot."""
    one = pick_one(rows, [*group, slot], order)
    return one.groupBy(*group).pivot(slot, list(slots)).agg(F.first(entity))
