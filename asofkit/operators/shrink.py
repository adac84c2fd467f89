"""Rates, league shares, empirical-Bayes shrinkage and prior-season effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.prob import clip, eb_rate, safe_div
from asofkit.operators.scan import group_totals


def class_counts(df: DataFrame, keys: Sequence[str], label: str, classes: Sequence[str], n: str = "n") -> DataFrame:
    """Row count and one count per class for each key; one partial aggregation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(n),
        *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).cast("long").alias(c) for c in classes],
    )


def category_shares(df: DataFrame, keys: Sequence[str], label: str, out: str = "rate") -> DataFrame:
    """Share of each label within its key."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return group_totals(counts, keys, __t=F.sum("n")).withColumn(out, F.col("n") / F.col("__t")).drop("__t")


def mom_sample_size(rates: DataFrame, n: str, classes: Sequence[str], lo: float = 20.0, hi: float = 2000.0) -> DataFrame:
    """Method-of-moments shrinkage size per class: p(1-p) / max(var - sampling noise, 1e-6).

    ``rates`` has one row per entity-season with exposure ``n`` and class rates.
    """
    long = rates.select(F.col(n).alias("n"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(c).alias("p")) for c in classes])).alias("x")).select("n", "x.*")
    # noise = pbar(1-pbar) * mean(1/n) because pbar is constant within the class
    agg = long.groupBy("cls").agg(
        F.avg("p").alias("m"), F.var_samp("p").alias("v"), F.avg(1.0 / F.col("n")).alias("inv"),
        F.count(F.lit(1)).alias("n_units"),
    )
    pq = F.col("m") * (1 - F.col("m"))
    return agg.select("cls", "n_units", clip(pq / F.greatest(F.col("v") - pq * F.col("inv"), F.lit(1e-6)), lo, hi).alias("k"))


def prior_factors(
    counts: DataFrame, group: Sequence[str], league_keys: Sequence[str], season: str, classes: Sequence[str], n: str,
    k: float, seasons_back: int | None = None, prefix: str = "f_",
) -> DataFrame:
    """Multipliers versus the league from earlier seasons only, shrunk to 1 by k rows.

    ``counts``: one row per (group, season). Output: (group, year) where year is the
    season that may use the factor; every year up to the season after the last one is
    present once the group has history in the window.
    """
    last = counts.agg(F.max(season) + 1).scalar()

    def spread(df: DataFrame) -> DataFrame:
        hi = F.col("__last") if seasons_back is None else F.least(F.col(season) + seasons_back, F.col("__last"))
        return df.withColumn("__last", last).withColumn("year", F.explode(F.sequence(F.col(season) + 1, hi)))

    league = counts.groupBy(*league_keys, season).agg(
        *[(F.sum(c) / F.sum(n)).alias(c) for c in classes])
    lg = spread(league).groupBy(*league_keys, "year").agg(*[F.avg(c).alias(f"__lg_{c}") for c in classes])
    own = spread(counts).groupBy(*group, "year").agg(F.sum(n).alias("__n"), *[F.sum(c).alias(c) for c in classes])
    w = F.col("__n") / (F.col("__n") + F.lit(float(k)))
    return own.join(lg, [*league_keys, "year"]).select(
        *group, "year",
        *[(1.0 + w * (safe_div(c, F.greatest(F.col("__n"), F.lit(1))) / F.greatest(F.col(f"__lg_{c}"), F.lit(1e-9)) - 1.0))
          .alias(prefix + c) for c in classes],
    )


def cumulative_prior(per_season: DataFrame, entity: Sequence[str], season: str, cols: Sequence[str]) -> DataFrame:
    """Sums over all earlier seasons of the entity (one row per entity-season in and out)."""
    w = Window.partitionBy(*entity).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    return per_season.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_prior") for c in cols])


def cumulative_eb_rate(
    per_season: DataFrame, entity: Sequence[str], season: str, hits: str, n: str, k: float, min_n: int, bound: float = 2.5
) -> DataFrame:
    """EB rate from strictly earlier seasons, then standardised and bounded."""
    lg = per_season.agg(F.sum(hits) / F.sum(n)).scalar()
    r = cumulative_prior(per_season, entity, season, [n, hits]).withColumn("__lg", lg)
    r = r.withColumn("rate", eb_rate(F.col(f"{hits}_prior"), F.col(f"{n}_prior"), F.col("__lg"), k))
    sd = r.filter(F.col(f"{n}_prior") >= min_n).agg(F.stddev_samp("rate")).scalar()
    z = (F.col("rate") - F.col("__lg")) / F.greatest(sd, F.lit(1e-6))
    return r.withColumn("z", clip(z, -bound, bound)).drop("__lg")


def season_zscore(df: DataFrame, col: str, by: Sequence[str], bound: float = 2.5, out: str = "z") -> DataFrame:
    """Standard score within a group, bounded; missing values score 0."""
    t = group_totals(df, by, __m=F.avg(col), __s=F.stddev_samp(col))
    z = (F.col(col) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return t.withColumn(out, F.coalesce(clip(z, -bound, bound), F.lit(0.0))).drop("__m", "__s")


def year_over_year(df: DataFrame, entity: Sequence[str], year: str, cols: Sequence[str]) -> DataFrame:
    """Change on the previous season, only when the seasons are consecutive."""
    w = Window.partitionBy(*entity).orderBy(year)
    step = F.col(year) - F.lag(year).over(w) == 1
    return df.select("*", *[F.when(step, F.col(c) - F.lag(c).over(w)).alias(f"{c}_chg") for c in cols])


def prior_season(left: DataFrame, dim: DataFrame, entity: Sequence[str], year: str, dim_year: str,
                 cols: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Equi join on last season's value: the dimension year is moved one ahead."""
    defaults = defaults or {}
    r = dim.select(*entity, (F.col(dim_year) + 1).alias(year), *[F.col(c).alias(f"__d_{c}") for c in cols])
    j = left.join(r, [*entity, year], "left")
    return j.select(*left.columns, *[
        (F.coalesce(F.col(f"__d_{c}"), F.lit(defaults[c])) if c in defaults else F.col(f"__d_{c}")).alias(c) for c in cols])


def two_level_mean(
    df: DataFrame, team: str, season: str, date: str, value: str, k_team: float, k_prev: float
) -> DataFrame:
    """Season-to-date mean before each day, shrunk to the club's last season, itself shrunk
    to last season's league mean; centred on that league mean. One row per (team, season, date)."""
    day = df.groupBy(team, season, date).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(team, season).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    run = day.select(team, season, date, F.coalesce(F.sum("__s").over(w), F.lit(0.0)).alias("__cs"),
                     F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__cn"))
    lg = df.groupBy(season).agg(F.avg(value).alias("lg_prev")).withColumn(season, F.col(season) + 1)
    club = df.groupBy(team, season).agg(F.sum(value).alias("__ps"), F.count(value).alias("__pn"))
    club = club.withColumn(season, F.col(season) + 1)
    j = run.join(lg, season, "left").join(club, [team, season], "left")
    prior = eb_rate(F.col("__ps"), F.col("__pn"), F.col("lg_prev"), k_prev)
    return j.select(team, season, date, "lg_prev",
                    (eb_rate(F.col("__cs"), F.col("__cn"), prior, k_team) - F.col("lg_prev")).alias("lean"))


def level_translation(
    low: DataFrame, high: DataFrame, entity: str, year: str, level: str, n: str, counts: Sequence[str],
    lo: float = 0.1, hi: float = 3.0,
) -> DataFrame:
    """Pooled rate ratio of the higher level to each lower level over movers of consecutive years."""
    h = high.select(entity, (F.col(year) - 1).alias(year), F.col(n).alias("__hn"), *[F.col(c).alias(f"__h_{c}") for c in counts])
    pairs = low.join(h, [entity, year])
    return pairs.groupBy(level).agg(*[
        clip((F.sum(f"__h_{c}") / F.greatest(F.sum("__hn"), F.lit(1)))
             / F.greatest(F.sum(c) / F.greatest(F.sum(n), F.lit(1)), F.lit(1e-6)), lo, hi).alias(f"f_{c}")
        for c in counts])


def translated_priors(
    low: DataFrame, factors: DataFrame, entity: str, year: str, level: str, n: str, counts: Sequence[str], last: int = 2
) -> DataFrame:
    """Prior for each entry year from the last ``last`` level-seasons before it, exposure-weighted."""
    # The last rows before year Y+1 are the last row of year Y and the rows just before it.
    order = Window.partitionBy(entity).orderBy(year, level)
    recent = order.rowsBetween(-(last - 1), 0)
    j = low.join(factors, level).withColumn("__next", F.lead(year).over(order))
    j = j.select(
        entity, (F.col(year) + 1).alias("entry"), F.col(year).alias("__y"), "__next",
        *[(F.sum(F.col(c) * F.col(f"f_{c}")).over(recent) / F.sum(n).over(recent)).alias(f"prior_{c}") for c in counts],
        F.sum(n).over(recent).alias("prior_n"))
    return j.filter(F.col("__next").isNull() | (F.col("__next") != F.col("__y"))).drop("__y", "__next")


def threshold_shares(
    rows: DataFrame, horizons: dict[str, tuple[DataFrame, float]], entity: Sequence[str], stats: Sequence[str], n: str,
    league: dict[str, Column], k: float, date: str = "d",
) -> DataFrame:
    """EB shares of clearing thresholds from several decayed horizons in one as-of pass."""
    from asofkit.operators.asof import multi_panel_asof

    j = multi_panel_asof(rows, entity, {h: (p, [n + "_d", *[s + "_d" for s in stats]], hl)
                                        for h, (p, hl) in horizons.items()}, date)
    out = [eb_rate(F.col(f"{h}_{s}_d"), F.col(f"{h}_{n}_d"), league[s], k).alias(f"{h}_{s}")
           for h in horizons for s in stats]
    first = next(iter(horizons))
    return j.select(*rows.columns, *out, F.log1p(F.coalesce(F.col(f"{first}_{n}_d"), F.lit(0.0))).alias("log_n"))
