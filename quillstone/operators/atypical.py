"""Rows that fit their label badly: adherence, divergence, references, enrichment of communities, mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.tails import hypergeometric_lower, hypergeometric_upper
from quillstone.functions.vectors import clip
from quillstone.operators.stats import bh


def adherence(sims: DataFrame, top: int = 15, temperature: float = 0.1, digits: int = 9) -> DataFrame:
    """(id, label, weight, adherence): softmax over each row's `top` similarities (id, label, sim); adherence is the largest weight."""
    near = sims.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.round("sim", digits).desc(), "label"))).where(F.col("r") <= top)
    by_row = Window.partitionBy("id")
    near = near.withColumn("e", F.exp((F.col("sim") - F.max("sim").over(by_row)) / temperature))
    near = near.withColumn("weight", F.col("e") / F.sum("e").over(by_row))
    return near.select("id", "label", "weight", F.max("weight").over(by_row).alias("adherence"))


def edge_adherence(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, adherence, child, parent): the best edge by the sum of its ends' weights, against the best node alone."""
    of = lambda c: weights.select("id", F.col("label").alias(c), F.col("weight").alias(c + "_w"))
    sums = of("child").join(F.broadcast(edges.select("child", "parent")), "child").join(of("parent"), ["id", "parent"])
    best = sums.groupBy("id").agg(F.max(F.struct((F.col("child_w") + F.col("parent_w")).alias("w"), "child", "parent")).alias("b"))
    node = weights.groupBy("id").agg(F.max("weight").alias("n"))
    return node.join(best, "id", "left").select("id", F.greatest("n", F.coalesce("b.w", F.lit(0.0))).alias("adherence"), "b.child", "b.parent")


def divergence(sims: DataFrame, scores: DataFrame, temperature: float = 0.1, floor: float = 1e-12) -> DataFrame:
    """(id, jsd) in bits between the softmax of all similarities and the scores brought to sum 1."""
    by_row = Window.partitionBy("id")
    rows = sims.join(scores, ["id", "label"]).withColumn("e", F.exp((F.col("sim") - F.max("sim").over(by_row)) / temperature))
    rows = rows.withColumn("s", F.greatest("score", F.lit(0.0))).withColumn("n", F.count("*").over(by_row))
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(by_row)).withColumn("q", F.when(F.sum("s").over(by_row) > 0, F.col("s") / F.sum("s").over(by_row)).otherwise(1 / F.col("n")))
    rows = rows.withColumn("p", (F.col("p") + floor) / (1 + floor * F.col("n"))).withColumn("q", (F.col("q") + floor) / (1 + floor * F.col("n")))
    m = F.col("p") + F.col("q")
    part = F.col("p") * F.log2(2 * F.col("p") / m) / 2 + F.col("q") * F.log2(2 * F.col("q") / m) / 2
    return rows.groupBy("id").agg(clip(F.sum(part), 0.0, 1.0).alias("jsd"))


def abnormality(features: DataFrame) -> DataFrame:
    """Adds abnormality to features (adherence, jsd, sim, margin): the mean of how far each is from a good fit."""
    parts = (1 - F.col("adherence")) + F.col("jsd") + (1 - F.col("sim")) / 2 + clip((1 - F.col("margin")) / 2, 0.0, 1.0)
    return features.withColumn("abnormality", parts / 4)


def class_references(rows: DataFrame, least: int = 30, least_left: int = 15, cut: float = -2.5) -> DataFrame:
    """(label, n, centre, scale, valid) of rows (label, value): median, and 1.4826 times the median distance below it.

    Too few rows or too small a scale is invalid; rows below `cut` scales go once and both are taken anew.
    """

    def fit(df: DataFrame) -> DataFrame:
        centre = df.groupBy("label").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("centre"))
        below = df.join(centre, "label").where("value <= centre").groupBy("label").agg((1.4826 * F.percentile(F.col("centre") - F.col("value"), F.lit(0.5))).alias("scale"))
        return centre.join(below, "label")

    first = fit(rows.select("label", "value"))
    good = first.where(F.col("n") >= least).where("scale > 1e-4")
    left = rows.join(good.select("label", F.col("centre").alias("c"), F.col("scale").alias("s")), "label").where((F.col("value") - F.col("c")) / F.col("s") >= cut)
    again = fit(left.select("label", "value")).select("label", F.col("n").alias("n2"), F.col("centre").alias("c2"), F.col("scale").alias("s2"))
    valid = F.coalesce((F.col("n2") >= least_left) & (F.col("s2") > 1e-4), F.lit(False))
    return first.join(again, "label", "left").select("label", "n", F.when(valid, F.col("c2")).alias("centre"), F.when(valid, F.col("s2")).alias("scale"), valid.alias("valid"))


def relative_adherence(rows: DataFrame, references: DataFrame, weight: float = 0.5) -> DataFrame:
    """Adds blended to rows (id, label, value): own value and the sigmoid of its place in its class, where that is valid."""
    joined = rows.join(references.where("valid").select("label", "centre", "scale"), "label", "left")
    place = 1 / (1 + F.exp(-clip((F.col("value") - F.col("centre")) / F.col("scale"), -60.0, 60.0)))
    blended = F.when(F.col("scale").isNotNull(), weight * F.col("value") + (1 - weight) * place).otherwise(F.col("value"))
    return joined.withColumn("blended", clip(blended, 0.0, 1.0)).drop("centre", "scale")


def aligned(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Adds aligned: source moved and scaled to the median and IQR of target, clipped to 0 to 1."""
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = rows.agg(F.percentile(source, quarters).alias("s"), F.percentile(target, quarters).alias("t"))
    s, t = (lambda i: F.col("s")[i]), (lambda i: F.col("t")[i])
    a, b = s(2) - s(0), t(2) - t(0)
    value = F.when(a <= 1e-4, F.col(source) + t(1) - s(1)).when(b <= 1e-4, t(1)).otherwise((F.col(source) - s(1)) * b / a + t(1))
    return rows.join(F.broadcast(q)).withColumn("aligned", clip(value, 0.0, 1.0)).drop("s", "t")


def enrichment_counts(rows: DataFrame, least_size: int = 20) -> DataFrame:
    """(community, n, k, population, marked, fraction, eligible) of rows (community, is_aberrant); community -1 is none."""
    whole = rows.agg(F.count("*").alias("population"), F.count_if("is_aberrant").alias("marked"))
    each = rows.groupBy("community").agg(F.count("*").alias("n"), F.count_if("is_aberrant").alias("k")).join(F.broadcast(whole))
    return each.withColumn("fraction", F.col("k") / F.col("n")).withColumn("eligible", (F.col("community") >= 0) & (F.col("n") >= least_size) & (F.col("marked") > 0))


def suspicious_communities(rows: DataFrame, least_size: int = 20, alpha: float = 0.05, floor: float = 0.1, ratio: float = 1.5) -> DataFrame:
    """enrichment_counts with p, q (over eligible ones alone) and suspicious: small q and a fraction well above the base."""
    counts = enrichment_counts(rows, least_size)
    tested = counts.withColumn("p", F.when(F.col("eligible"), hypergeometric_upper("k", "population", "marked", "n")))
    base = F.col("marked") / F.col("population")
    high = F.col("fraction") >= F.least(base + floor, ratio * base)
    return bh(tested, "p").withColumn("suspicious", F.coalesce(F.col("eligible") & (F.col("q") < alpha) & high, F.lit(False)))


def protected_classes(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(label, n, k, p, q, protected): classes with fewer aberrant rows than chance would give; rows: (label, is_aberrant)."""
    whole = rows.agg(F.count("*").alias("population"), F.count_if("is_aberrant").alias("marked"))
    each = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_aberrant").alias("k")).join(F.broadcast(whole))
    return bh(each.withColumn("p", hypergeometric_lower("k", "population", "marked", "n")), "p").withColumn("protected", F.col("q") < alpha).select("label", "n", "k", "p", "q", "protected")


def mixture(values: np.ndarray, weights: np.ndarray | None = None, components: int = 10, concentration: float = 0.4, rounds: int = 300) -> dict[str, np.ndarray]:
    """One-dimensional mixture by variational updates with a Dirichlet-process prior on the shares: weight, mean, sd.

    values may be bin centres with their counts as weights, so that all rows count however many they are.
    """
    from math import lgamma

    x = np.asarray(values, dtype=float)
    w = np.ones_like(x) if weights is None else np.asarray(weights, dtype=float)
    digamma = np.vectorize(lambda a: (lgamma(a + 1e-5) - lgamma(a - 1e-5)) / 2e-5 if a > 1e-4 else -1 / a)
    order = np.argsort(x)
    at = np.searchsorted(np.cumsum(w[order]) / w.sum(), (np.arange(components) + 0.5) / components)
    mean0, var0 = np.average(x, weights=w), max(np.average((x - np.average(x, weights=w)) ** 2, weights=w), 1e-12)
    m, beta, a, b = x[order][np.minimum(at, len(x) - 1)].copy(), np.ones(components), np.ones(components), np.full(components, var0 / components**2 + 1e-9)
    g1, g2 = np.ones(components), np.full(components, concentration)
    for _ in range(rounds):
        stick = digamma(g1) - digamma(g1 + g2)
        rest = np.concatenate([[0], np.cumsum(digamma(g2) - digamma(g1 + g2))[:-1]])
        log = (stick + rest)[None, :] + 0.5 * (digamma(a) - np.log(b))[None, :] - 0.5 * (a / b)[None, :] * (x[:, None] - m[None, :]) ** 2 - 0.5 / beta[None, :]
        r = np.exp(log - log.max(axis=1, keepdims=True))
        r = r / r.sum(axis=1, keepdims=True) * w[:, None]
        n = r.sum(axis=0) + 1e-10
        xbar = (r * x[:, None]).sum(axis=0) / n
        s = (r * (x[:, None] - xbar) ** 2).sum(axis=0)
        beta, before = 1 + n, m
        m = (mean0 + n * xbar) / beta
        a, b = 1 + n / 2, var0 * 0.1 + 0.5 * (s + n / beta * (xbar - mean0) ** 2)
        g1, g2 = 1 + n, concentration + np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0]])
        if np.abs(m - before).max() < 1e-8:
            break
    return {"weight": n / n.sum(), "mean": m, "sd": np.sqrt(b / a)}


def mixture_seeds(rows: DataFrame, column: str = "abnormality", threshold: float = 0.38, bins: int = 2000, least: int = 50) -> DataFrame:
    """Adds is_seed: rows at or above the smallest value that a narrow, weighty component over the threshold reaches.

    The fit is over a histogram of all rows; below `least` rows there is no seed.
    """
    at = F.least(F.floor(clip(F.col(column), 0.0, 1.0) * bins), F.lit(bins - 1)).cast("int")
    found = {r["b"]: r["n"] for r in rows.where(F.col(column).isNotNull()).groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()}  # at most `bins` rows
    if sum(found.values()) < least:
        return rows.withColumn("is_seed", F.lit(False))
    fit = mixture((np.array(list(found)) + 0.5) / bins, np.array(list(found.values())))
    good = (fit["weight"] >= 0.01) & (fit["sd"] <= 0.2) & (fit["mean"] >= threshold)
    low = float((fit["mean"] - fit["sd"])[good].min()) if good.any() else 2.0
    return rows.withColumn("is_seed", F.coalesce(F.col(column) >= max(low, threshold), F.lit(False)))
