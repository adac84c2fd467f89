"""Batch merges for streams: captures, ledger generations, retries, late rows, freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from asofkit.operators.market import append_superseding, compact_captures
from asofkit.operators.quality import freshness
from asofkit.sources.files import replace_partitions
from asofkit.sources.repair import empty_attempts


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def capture_merge(path: str, keys: list[str], slot: str) -> Callable[[DataFrame, int], None]:
    """Fold a micro-batch of captures into the store, rewriting only the partitions (``slot``) it touches.

    Folding the same captures twice changes nothing, so a repeated batch is harmless.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, slot, "ts", "over", "under", "arr")
        if _exists(spark, path):
            old = spark.read.parquet(path).join(batch.select(slot).distinct(), slot, "left_semi")
            rows = rows.unionByName(old.select(*keys, slot, F.col("close_ts").alias("ts"), F.col("close_over").alias("over"), F.col("close_under").alias("under"),
                                               F.lit(-1).cast("long").alias("arr"), "open_ts", "open_over", "open_under"), allowMissingColumns=True)
        s = compact_captures(rows, [*keys, slot], "ts", "over", "under", "arr", F.floor(F.col("arr") / 1000)).drop("n_captures")
        replace_partitions(s, path, [slot])

    return each


def ledger_merge(path: str) -> Callable[[DataFrame, int], None]:
    """Append a re-served generation to the ledger of its dates with the supersede rule; a repeated batch adds nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("epoch", F.lit(epoch))
        if not _exists(spark, path):
            replace_partitions(new, path, ["d"])
            return
        old = spark.read.parquet(path).join(batch.select("d").distinct(), "d", "left_semi")
        seen = old.filter(F.col("epoch") == epoch).select("seq").distinct()
        fresh = new.join(seen, "seq", "left_anti")
        replace_partitions(append_superseding(old, fresh.select(*old.columns)), path, ["d"])

    return each


def retry_merge(path: str, key: str, order: list[str], rows: str, limit: int = 3) -> Callable[[DataFrame, int], None]:
    """Misses since the last hit per key, carried across batches as one small row per key."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hit = batch.groupBy(key).agg((F.max(rows) > 0).alias("__hit"))
        now = empty_attempts(batch, key, order, rows, limit).drop("give_up").join(hit, key)
        held = spark.read.parquet(path).filter(F.col("v") < epoch) if epoch > 0 and _exists(spark, path) else None
        newest = held.agg(F.max("v")).scalar() if held is not None else None
        if newest is not None:  # the newest version below this epoch, whatever epochs had no rows
            old = held.filter(F.col("v") == newest).select(key, F.col("misses").alias("__old"))
            now = now.join(old, key, "full_outer").select(key, F.when(F.coalesce("__hit", F.lit(False)), F.col("misses")).otherwise(
                F.coalesce("misses", F.lit(0)) + F.coalesce("__old", F.lit(0))).alias("misses"))
        now.select(key, "misses").write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return each


def late_split(path: str, mark: Column, late: Callable[[Column], Column]) -> Callable[[DataFrame, int], None]:
    """Every row with its verdict, in a table beside the stream: ``late`` is a test of the row against the highest ``mark`` of earlier batches.

    A stream drops what comes behind its watermark without a word; this keeps those rows for repair.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        top = None
        if epoch > 0 and _exists(spark, f"{path}/marks"):
            top = spark.read.parquet(f"{path}/marks").filter(F.col("epoch") < epoch).agg(F.max("top")).scalar()
        verdict = F.lit(False) if top is None else F.coalesce(late(top), F.lit(False))
        batch.withColumn("late", verdict).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        batch.agg(F.max(mark).alias("top")).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/marks")

    return each


def freshness_watch(path: str, date: str, today: str, max_age: int, group: list[str]) -> Callable[[DataFrame, int], None]:
    """Newest date per group after every batch, judged against a reference day."""

    def each(batch: DataFrame, epoch: int) -> None:
        freshness(batch, date, today, max_age, group).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/e={epoch}")

    return each


class NewestDateListener(StreamingQueryListener):
    """Reads the newest date out of an ``observe`` metric of each batch and flags a stale stream."""

    def __init__(self, metric: str, field: str, limit: str, on_stale: Callable[[str], None]):
        self.metric, self.field, self.limit, self.on_stale = metric, field, limit, on_stale

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.metric)
        if row is not None and row[self.field] is not None and str(row[self.field]) < self.limit:
            self.on_stale(str(row[self.field]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
