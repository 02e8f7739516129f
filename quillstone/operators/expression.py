"""Quality control and normalisation of long-format measurements (cell, gene, value); an absent pair is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vectors import clip
from quillstone.operators.lineage import running

#: What keeps logarithms and quotients of the knee finite.
TINY = 1e-10


def qc_metrics(expr: DataFrame, cells: DataFrame, marked: Column, min_total: float = 500, min_genes: int = 200, max_marked_pct: float = 20.0) -> DataFrame:
    """total, genes, marked_pct and qc_pass of every cell, those without measurements as well; marked: condition on expr's rows."""
    sums = expr.groupBy("cell").agg(
        F.sum("value").alias("total"),
        F.count_if(F.col("value") != 0).alias("genes"),
        F.sum(F.when(marked, F.col("value")).otherwise(0.0)).alias("marked"),
    )
    rows = cells.join(sums, "cell", "left").fillna(0, ["total", "genes", "marked"])
    pct = F.when(F.col("total") > 0, 100 * F.col("marked") / F.col("total")).otherwise(0.0)
    rows = rows.withColumn("marked_pct", pct).drop("marked")
    return rows.withColumn("qc_pass", (F.col("total") >= min_total) & (F.col("genes") >= min_genes) & (F.col("marked_pct") <= max_marked_pct))


def classify_values(expr: DataFrame) -> DataFrame:
    """One row: kind (raw_counts, log1p_like or unsupported) and the shares that decide it, over all non-zero values."""
    v = F.col("value")
    shares = expr.where(v != 0).agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or((v < 0) | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)).alias("odd"),
        F.coalesce(F.avg((F.abs(v - F.round(v)) < 1e-6).cast("double")), F.lit(0.0)).alias("whole"),
        F.coalesce(F.avg(((v > 0) & (v < 1)).cast("double")), F.lit(0.0)).alias("small"),
        F.max(v).alias("top"),
    )
    kind = (
        F.when(F.col("odd") | (F.col("n") == 0), "unsupported")
        .when((F.col("whole") >= 0.98) & (F.col("small") <= 0.001), "raw_counts")
        .when((F.col("whole") < 0.8) & (F.col("small") >= 0.05) & (F.col("top") <= 10), "log1p_like")
        .otherwise("unsupported")
    )
    return shares.withColumn("kind", kind)


def counts_from_log(expr: DataFrame) -> DataFrame:
    """expm1 of values clipped to 0 to 10."""
    return expr.withColumn("value", F.expm1(clip(F.col("value"), 0.0, 10.0)))


def library_sizes(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell").agg(F.sum("value").alias("total"))


def log_normalised(expr: DataFrame) -> DataFrame:
    """Each cell scaled to the median library size, log1p; rows of value 0 go."""
    sizes = library_sizes(expr)
    target = sizes.agg(F.percentile("total", F.lit(0.5)).alias("target"))
    scale = F.col("target") / F.greatest(F.col("total"), F.lit(1.0))
    out = expr.join(sizes, "cell").join(F.broadcast(target))  # one row
    return out.select("cell", "gene", F.log1p(F.col("value") * scale).alias("value")).where("value > 0")


def clip_cutoff(normalised: DataFrame, share: float = 0.995) -> DataFrame:
    """One row: the cutoff of positive values."""
    return normalised.where("value > 0").agg(F.percentile("value", F.lit(share)).alias("cutoff"))


def clipped(normalised: DataFrame, cutoff: DataFrame | float | None = None) -> DataFrame:
    """Values up to the cutoff: of these rows, of a table of one row, or a number (which a stream needs)."""
    if isinstance(cutoff, int | float):
        return normalised.withColumn("value", F.least("value", F.lit(float(cutoff))))
    top = clip_cutoff(normalised) if cutoff is None else cutoff
    return normalised.join(F.broadcast(top)).withColumn("value", F.least("value", "cutoff")).drop("cutoff")  # one row


def model_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, pos, value) for the genes (gene, pos) that a model knows; of a gene given twice the last place counts."""
    last = genes.groupBy("gene").agg(F.max("pos").alias("pos"))
    return expr.join(last, "gene").groupBy("cell", "pos").agg(F.sum("value").alias("value"))


def coverage(expr: DataFrame, genes: DataFrame, sample: int = 20) -> DataFrame:
    """One row: found, required, pct, and the first missing genes by name (at most `sample`)."""
    have = expr.select("gene").distinct().withColumn("here", F.lit(1))
    marked = genes.select("gene").distinct().join(have, "gene", "left")
    few = marked.where("here is null").orderBy("gene").limit(sample).agg(F.array_sort(F.collect_list("gene")).alias("missing"))
    found = marked.agg(F.count("here").alias("found"), F.count("*").alias("required"))
    return found.join(F.broadcast(few)).withColumn("pct", F.when(F.col("required") > 0, 100 * F.col("found") / F.col("required")).otherwise(0.0))


def knee(rows: DataFrame, column: str = "value") -> DataFrame:
    """One row: threshold by the largest distance to the chord of the descending curve above the median, in logarithms.

    Under ten rows: 0; a mean above 0 and a variation under .1: just above the largest; fewer than ten
    rows above the median: Q3 + 1.5 IQR. Of one value, the first and the last rank may be the farthest.
    """
    v = F.col(column).cast("double")
    stats = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.max(v).alias("top"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    above = rows.select(v.alias("v")).join(F.broadcast(stats.select(F.col("q")[1].alias("median")))).where("v > median").groupBy("v").agg(F.count("*").alias("c"))
    ranked = running(above, [F.col("v").desc()], F.col("c"), "before")
    ranked = ranked.withColumn("rank", F.explode(F.array(F.col("before") + 1, F.col("before") + F.col("c"))))
    xy = ranked.select("v", "rank", F.log10("rank").alias("x"), F.log10(F.col("v") + TINY).alias("y"))
    ends = xy.agg(F.max("x").alias("x1"), F.max("y").alias("y0"), F.min("y").alias("y1"), F.max("rank").alias("above"))
    lx, ly = F.col("x") / (F.col("x1") + TINY), (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0") + TINY)
    last_x, last_y = F.col("x1") / (F.col("x1") + TINY), (F.col("y1") - F.col("y0")) / (F.col("y1") - F.col("y0") + TINY)
    distance = F.round(F.abs(last_y * lx - last_x * ly), 9)  # the curve starts at (0, 0)
    far = xy.join(F.broadcast(ends)).where("above >= 10").agg(F.max(F.struct(distance.alias("d"), (-F.col("rank")).alias("first"), "v")).alias("far"))
    threshold = (
        F.when(F.col("n") < 10, 0.0)
        .when((F.col("mean") > 0) & (F.col("sd") / F.col("mean") < 0.1), F.col("top") + 1)
        .when(F.col("far").isNotNull(), F.col("far.v"))
        .otherwise(F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0]))
    )
    return stats.join(F.broadcast(far)).select(threshold.alias("threshold"))


def low_quality(rows: DataFrame, column: str = "value", threshold: float | None = None) -> DataFrame:
    """Adds is_low_quality: the value is above the threshold, that of `knee` if none is given."""
    if threshold is not None:
        return rows.withColumn("is_low_quality", F.col(column) > threshold)
    return rows.join(F.broadcast(knee(rows, column))).withColumn("is_low_quality", F.col(column) > F.col("threshold")).drop("threshold")  # one row


def entropy_threshold(rows: DataFrame, column: str = "entropy") -> float:
    """Above it a row is uncertain: the upper of Otsu's cuts into three, of two if there is no third; under ten rows 0, under a deviation of .05 above all."""
    v = F.col(column).cast("double")
    n, sd, top = rows.agg(F.count(v), F.stddev_pop(v), F.max(v)).first()
    if n < 10:
        return 0.0
    if sd < 0.05:
        return float(top) + 1
    return otsu(rows, column, 3)[-1]


def otsu(rows: DataFrame, column: str = "value", classes: int = 3, bins: int = 256) -> list[float]:
    """Cuts between `classes` (2 or 3) by the largest variance between them, over a histogram of `bins`."""
    import numpy as np

    v = F.col(column).cast("double")
    low, high = rows.agg(F.min(v), F.max(v)).first()
    if low is None or high <= low:
        return []
    at = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    n = np.zeros(bins)
    for r in rows.where(v.isNotNull()).groupBy(at.alias("b")).count().collect():  # at most `bins` rows
        n[r["b"]] = r["count"]
    mid = low + (np.arange(bins) + 0.5) * (high - low) / bins
    w, m = np.cumsum(n), np.cumsum(n * mid)
    between = lambda i, j: (m[j] - (m[i] if i >= 0 else 0)) ** 2 / max(w[j] - (w[i] if i >= 0 else 0), 1e-300)
    if classes == 2:
        best = max(range(bins - 1), key=lambda i: between(-1, i) + between(i, bins - 1))
        return [float(mid[best])]
    best = max(((i, j) for i in range(bins - 2) for j in range(i + 1, bins - 1)), key=lambda ij: between(-1, ij[0]) + between(ij[0], ij[1]) + between(ij[1], bins - 1))
    return [float(mid[i]) for i in best]
