"""Late data: completeness counts, repair lists, watermarks and negative caches (batch form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stub_counts(finals: DataFrame, stored: DataFrame, key: str, date: str, until: str, horizon: int, floor: int) -> DataFrame:
    """Stored rows of every final in the horizon, zeros included; fewer than ``floor`` marks a stub."""
    t = F.lit(until).cast("date")
    f = finals.filter((F.col(date) <= t) & (F.col(date) >= F.date_sub(t, horizon)))
    c = stored.join(f.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return f.join(c, key, "left").select(date, key, n.alias("n"), (n < floor).alias("stub"))


def open_repairs(stubs: DataFrame, memo: DataFrame, key: str) -> DataFrame:
    """Stubs still worth a refetch: a memo row with the same count says the source has no more."""
    settled = memo.select(key, "n")
    return stubs.filter("stub").join(settled, [key, "n"], "left_anti")


def watermark(stored: Sequence[DataFrame], date: str, overlap_days: int) -> DataFrame:
    """Refetch start: the earliest of the stored files' newest dates, minus the overlap."""
    tops = None
    for df in stored:
        m = df.agg(F.max(date).alias("newest"))
        tops = m if tops is None else tops.unionByName(m)
    return tops.agg(F.date_sub(F.min("newest"), overlap_days).alias("start"))


def refetch_merge(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], date: str, overlap_days: int) -> DataFrame:
    """Trim the stored table to before the watermark, append the refetched rows, keep the last per key."""
    start = watermark([stored], date, overlap_days).scalar()
    old = stored.filter(F.col(date) < start).withColumn("__gen", F.lit(0))
    new = fresh.filter(F.col(date) >= start).withColumn("__gen", F.lit(1))
    return keep_last(old.unionByName(new, allowMissingColumns=True), keys, ["__gen"]).drop("__gen")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Refetched rows win: the greatest in ``order`` per key, by a partially combined aggregation."""
    others = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__v"))
    return ranked.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in others])


def empty_attempts(log: DataFrame, key: str, order: Sequence[str], rows: str, limit: int = 3) -> DataFrame:
    """Attempts that came back empty since the last one with data; ``limit`` of them stops the retries."""
    rank = F.struct(*order)
    last = log.groupBy(key).agg(F.max(F.when(F.col(rows) > 0, rank)).alias("__hit"))
    j = log.join(last, key).withColumn("__miss", F.when(F.col("__hit").isNull() | (rank > F.col("__hit")), 1).otherwise(0))
    return j.groupBy(key).agg(F.sum("__miss").alias("misses")).withColumn("give_up", F.col("misses") >= limit)


def hole_filling(universe: DataFrame, values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Unmatched rows stay as visible NULL rows, so the repair list is a filter."""
    return universe.join(values.select(*keys, *cols), list(keys), "left").withColumn("hole", F.col(cols[0]).isNull())


def prefer_filled(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row per key: rows with a value outrank NULL ones, then the latest."""
    return keep_last(df.withColumn("__has", F.col(value).isNotNull()), keys, ["__has", *order]).drop("__has")


def upsert_keys(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop stored rows of every key present in ``fresh``, then append it."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def add_missing_keys(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], stamp: str, lookup: DataFrame) -> DataFrame:
    """Backfill a partition: only keys not stored yet, with ``stamp`` filled from a lookup where older rows lack it."""
    new = fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    both = stored.unionByName(new, allowMissingColumns=True)
    j = both.join(lookup.select(*keys, F.col(stamp).alias("__s")), list(keys), "left")
    return j.withColumn(stamp, F.coalesce(stamp, "__s")).drop("__s")


def season_cache(stored: DataFrame, current: DataFrame | None, season: str, cur: int) -> DataFrame:
    """Completed seasons from the store, the current one from the fetch (or the store when it failed)."""
    if current is None:
        return stored
    return stored.filter(F.col(season) < cur).unionByName(current.filter(F.col(season) == cur), allowMissingColumns=True)


def newest_version(files: DataFrame, date: str, version: str, path: str) -> DataFrame:
    """Highest version per date."""
    return files.groupBy(date).agg(F.max_by(path, F.struct(version, path)).alias(path), F.max(version).alias(version))

