"""Continuous COPY: a stream of rows is routed and appended shard by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.routing import with_shard


def routed(stream: DataFrame, meta, relation: str) -> DataFrame:
    """A streaming table with each row's shard; the same expressions as for a batch."""
    return with_shard(stream, meta, relation)


def load(stream: DataFrame, meta, relation: str, path: str, checkpoint: str, rejected: str | None = None, available_now: bool = True):
    """Appends a stream's rows to one folder a shard, each batch once; rows without a shard go to ``rejected``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("__shard is not null").write.mode("overwrite").partitionBy("__shard").parquet(f"{path}/batch={number}")
        if rejected is not None:
            batch.where("__shard is null").drop("__shard").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    writer = routed(stream, meta, relation).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts(stream: DataFrame, meta, relation: str, time: str, window: str, late: str) -> DataFrame:
    """Rows of each shard by time window; rows later than ``late`` behind the newest are left out."""
    rows = with_shard(stream, meta, relation).withWatermark(time, late)
    return rows.groupBy(F.window(time, window), "__shard").agg(F.count("*").alias("n"))
