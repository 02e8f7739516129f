"""Cuts of lineage, and running totals over a whole table without one task for all of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master gets a temporary folder instead."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="quillstone-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder that the driver and all executors see."""
    return f"{_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, in a reliable checkpoint below spark.checkpoint.dir, which a cluster must set."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Writes df once as Parquet in a new shared folder, where it stays; the folder's URI, and df read from it.

    For large tables: a checkpoint holds whole rows, uncompressed.
    """
    home = shared_folder(df.sparkSession, name)
    df.write.parquet(home)
    return home, df.sparkSession.read.schema(df.schema).parquet(home)


def running(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before each, in an order that is total.

    Rows are dealt out by ranges of the order; what is summed up in one place is one row per range.
    """
    dealt = cut(df.withColumn(out, amount).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy("_part").agg(F.sum(out).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(out).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.withColumn(out, inside).join(F.broadcast(before), "_part")  # one row for each partition
    return rows.withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
