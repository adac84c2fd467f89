"""Readers and sinks for tables kept as files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header that may start with a byte-order mark. Names come from the schema, so the
    mark never becomes a part of one; NaN text becomes NULL."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nanValue", "").csv(path)
    if columns:
        df = df.select(*columns)
    return df


def read_seasons(spark: SparkSession, path: str, columns: Sequence[str], seasons: Sequence[int] | None = None) -> DataFrame:
    """Projected columns of a season-partitioned archive; only the asked partitions are read."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if seasons is not None:
        df = df.filter(F.col("season").isin(*seasons))
    return df.select(*columns)


def with_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Add every missing column as NULL of the given type."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in needed.items() if c not in have])


def tolerant_union(frames: Sequence[DataFrame], must_have: str) -> DataFrame:
    """Union of the frames that carry ``must_have``; other missing columns become NULL."""
    out = None
    for f in frames:
        if must_have in f.columns:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source has column {must_have}")
    return out


def require_columns(df: DataFrame, cols: Sequence[str], context: str, lax: bool = False) -> DataFrame:
    """Fail on missing source columns, or add them as NULL in lax mode."""
    missing = [c for c in cols if c not in df.columns]
    if missing and not lax:
        raise ValueError(f"{context}: missing columns {missing}")
    return with_columns(df, {c: "string" for c in missing})


def map_schema(df: DataFrame, mapping: dict[str, tuple[str, str]], context: str, lax: bool = False) -> DataFrame:
    """Source columns to canonical names and types: {target: (source, type)}."""
    src = require_columns(df, [s for s, _ in mapping.values()], context, lax)
    return src.select(*[F.col(s).try_cast(t).alias(n) for n, (s, t) in mapping.items()])


def write_store(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a derived table, clustered by its partition columns so files stay few."""
    out = df.repartition(*partition_by) if partition_by else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_archive(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def manifest(spark: SparkSession, stores: dict[str, DataFrame], date: str | None = None) -> DataFrame:
    """One row per store with its size and newest date."""
    out = None
    for name, df in stores.items():
        newest = F.max(date).cast("string") if date and date in df.columns else F.lit(None).cast("string")
        m = df.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), newest.alias("newest"))
        out = m if out is None else out.unionByName(m)
    return out


def melt_sidecar(df: DataFrame, ids: Sequence[str], value: str = "p", name: str = "column") -> DataFrame:
    """Wide forecast columns as rows (ids..., column, p)."""
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, name, value)


def file_versions(path: Column, pattern: str) -> tuple[Column, Column]:
    """Date text and version number out of file names like slate_2024-01-05_v2."""
    return F.regexp_extract(path, pattern, 1), F.coalesce(F.regexp_extract(path, pattern, 2).try_cast("int"), F.lit(1))


def newest_folders(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """Per date the version and folder of its newest files under ``base``, from the files' paths alone (contents stay unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base).select("path")
    day, version = file_versions(F.col("path"), pattern)
    named = files.select(day.alias("d"), version.alias("version"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).filter("d <> ''")
    return named.groupBy("d").agg(F.max("version").alias("version"), F.max_by("folder", F.struct("version", "folder")).alias("folder"))


def read_newest(spark: SparkSession, base: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest version of every date; older versions are not opened.

    One path per date passes the driver, which has to name the paths to read anyway.
    """
    folders = sorted(r.folder for r in newest_folders(spark, base, pattern).select("folder").toLocalIterator())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*folders)
