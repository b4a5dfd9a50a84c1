"""Numbers and running totals over a whole order, without a task that holds all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is named, a temporary one for a master in one process, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once beside the checkpoints and read back: a checkpoint works its rows out twice, and hands on constraints and sizes that grow from round to round of a loop."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, order: list[str | Column], **sums: Column) -> DataFrame:
    """rows with a column for each of sums: its total over the rows up to each one, itself included.

    Rows are dealt by ranges of the order and written once, so that the ranges' own totals and the rows after them come from one
    dealing; a range's offset is the sum of those before it, of which there are as many as partitions. The order must be total, or ties are numbered in any way.
    """
    checkpoint_dir(rows.sparkSession)
    own = {f"__{k}": v for k, v in sums.items()}
    placed = rows.withColumns(own).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("__part").agg(*[F.sum(k).alias(k) for k in own])
    before = ranges.select("__part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in own])
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(before), "__part").withColumns({k: F.sum(f"__{k}").over(here) + F.col(f"__{k}_before") for k in sums})
    return out.drop("__part", *own, *[f"{k}_before" for k in own])
