"""Running streams to completion and keeping their results as tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asofkit.sources.files import shared_path
from asofkit.sources.repair import keep_last


@dataclass(frozen=True)
class Arrivals:
    """Rows staged as arrivals; a stream sees an arrival once it is released into the inbox."""

    spark: SparkSession
    path: str
    n: int
    schema: StructType

    def release(self, i: int) -> bool:
        """Move arrival ``i`` into the inbox (one rename of its folder, whatever its size); false if it has no rows."""
        jvm = self.spark.sparkContext._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{self.path}/staged/__part={i}", f"{self.path}/inbox/a{i}"))
        fs = source.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(source):
            return False
        fs.mkdirs(target.getParent())
        return fs.rename(source, target)


def stage(df: DataFrame, part: Column, n_parts: int, name: str) -> Arrivals:
    """Rows written as ``n_parts`` arrivals in one pass, with as many tasks as the input has."""
    path = shared_path(df.sparkSession, name)
    df.withColumn("__part", part).write.partitionBy("__part").parquet(f"{path}/staged")
    return Arrivals(df.sparkSession, path, n_parts, df.schema)


def open_stream(arrivals: Arrivals) -> DataFrame:
    """A stream over what is released; all files of an arrival are one batch."""
    return arrivals.spark.readStream.schema(arrivals.schema).parquet(f"{arrivals.path}/inbox/*")


def drain(stream: DataFrame, arrivals: Arrivals, each: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Release one arrival after the other and run the stream until it has processed it. Offsets and state live in the shared folder, so every run goes on where the last one ended.

    State has as many partitions as the session's shuffle setting at the start; no setting is changed here.
    """
    offsets = shared_path(arrivals.spark, f"offsets-{name}")
    for i in range(arrivals.n):
        if arrivals.release(i):
            stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, arrivals: Arrivals, name: str, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Latest version of every key that an updating stream has emitted."""
    path = shared_path(stream.sparkSession, name)

    def each(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a repeated epoch overwrites itself
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/e={epoch}")

    drain(stream, arrivals, each, name, mode)
    return keep_last(stream.sparkSession.read.parquet(path).drop("e"), list(keys), ["epoch"]).drop("epoch")
