"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master, which is one process, may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/rangeloom-tables"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table's rows, evaluated once and read back; survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, first: int = 0) -> tuple[DataFrame, int]:
    """(the rows in their order, with consecutive numbers; their count), without gathering them: counts by partition give the offsets."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = written(df.select("*", part.alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "numbered")
    starts, at = {}, first
    for r in rows.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # a row a partition
        starts[r["__part"]], at = at, at + r["n"]
    if not starts:
        return rows.drop("__part", "__place").withColumn(column, F.lit(None).cast("long")), 0
    begin = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    return rows.withColumn(column, F.element_at(begin, F.col("__part")).cast("long") + F.col("__place")).drop("__part", "__place"), at - first
