"""Operators that need no more than a row at a time, or sums by window, on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import cosine


def classified(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """(…, label, sim): the nearest prototype of each row of a stream with a column z; protos is static and small, one row after aggregation."""
    packed = protos.agg(F.collect_list(F.struct("label", "v")).alias("protos"))
    best = F.array_max(F.transform("protos", lambda p: F.struct(F.round(cosine(F.col("z"), p.v), 9).alias("sim"), p.label.alias("label"))))
    return rows.join(F.broadcast(packed)).withColumn("best", best).select(*rows.columns, F.col("best.label").alias("label"), F.col("best.sim").alias("sim"))


def normalised(rows: DataFrame, target: float, cutoff: float) -> DataFrame:
    """Measurements (cell, total, value) scaled and clipped by numbers fixed beforehand: with a cutoff of the whole data set a batch would change its own."""
    return rows.withColumn("value", F.least(F.log1p(F.col("value") * target / F.greatest(F.col("total"), F.lit(1.0))), F.lit(cutoff)))


def qc_by_window(rows: DataFrame, time: str, late: str, width: str, marked: Column) -> DataFrame:
    """Totals, counts and marked share by window and cell, with a watermark."""
    sums = rows.withWatermark(time, late).groupBy(F.window(time, width), "cell").agg(F.sum("value").alias("total"), F.count_if(F.col("value") != 0).alias("genes"), F.sum(F.when(marked, F.col("value")).otherwise(0.0)).alias("marked"))
    return sums.withColumn("marked_pct", F.when(F.col("total") > 0, 100 * F.col("marked") / F.col("total")).otherwise(0.0)).drop("marked")
