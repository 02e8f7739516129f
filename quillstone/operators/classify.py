"""Prototypes, similarity to them, consensus scores, and top-k labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vectors import clip, cosine

GEOMETRY_SHARE = 0.85
PROFILE_TOP = 15
UNSEEN_SCORE = 1e-10
BROADCAST_PROTOTYPES = 100_000


def prototypes(rows: DataFrame) -> DataFrame:
    """(label, v): the mean vector of each label's rows (label, z)."""
    parts = rows.select("label", F.posexplode("z").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", F.transform("v", lambda e: e.x).alias("v"))


def similarities(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """(id, label, sim) of every row with every prototype: classes are few, and broadcast while they are counted to be."""
    held = F.broadcast(protos) if protos.count() <= BROADCAST_PROTOTYPES else protos
    return rows.select("id", "z").join(held.select("label", "v")).select("id", "label", cosine(F.col("z"), F.col("v")).alias("sim"))


def top_k(scores: DataFrame, k: int, column: str = "score", digits: int | None = None, then: str | None = None) -> DataFrame:
    """Scores (id, label, score) with their rank, up to k per id; on ties the larger `then`, if given, and the smaller label."""
    by = [F.col(c) if digits is None else F.round(c, digits) for c in (column, then) if c]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*[c.desc() for c in by], "label"))).where(F.col("rank") <= k)


def classified(rows: DataFrame, protos: DataFrame, digits: int = 9) -> DataFrame:
    """(id, label, sim, margin): the nearest prototype and its lead over the next."""
    two = top_k(similarities(rows, protos), 2, "sim", digits)
    first = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    best = two.groupBy("id").agg(first("label", 1).alias("label"), first("sim", 1).alias("sim"), first("sim", 2).alias("next"))
    return best.select("id", "label", "sim", (F.col("sim") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def expanded(expert: DataFrame, labels: DataFrame) -> DataFrame:
    """Expert scores (id, label, score) over all labels; one the expert has not seen scores UNSEEN_SCORE."""
    grid = expert.select("id").distinct().join(F.broadcast(labels.select("label").distinct()))
    return grid.join(expert, ["id", "label"], "left").withColumn("score", F.coalesce("score", F.lit(UNSEEN_SCORE)))


def profile_scores(observed: DataFrame, theoretical: DataFrame) -> DataFrame:
    """(id, label, profile): Pearson, floored at 0, of a row's similarities (id, seen, x) with each label's expected ones (label, seen, y)."""
    pairs = observed.join(theoretical, "seen")
    return pairs.groupBy("id", "label").agg(F.greatest(F.coalesce(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("profile"))


def consensus(scores: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, label, score, tier) of scores (id, label, expert, geometry, profile, seen).

    c is the lead in geometry of the expert's two best seen labels, at least 0. The score is
    .8c expert + (.1c + .6(1-c)) geometry + (.1c + .4(1-c)) profile, for labels that have .85 of
    the row's best geometry, or a profile among its 15 best, or lie one hop of the ontology
    (neighbours: label, near) from the expert's three best; all else scores 0. tier: gold, silver or
    bronze as three, two or none of the three agree on their best label.
    """
    by_row = Window.partitionBy("id")
    rank = lambda c, seen=None: F.row_number().over(Window.partitionBy("id").orderBy(*([F.col(seen).desc()] if seen else []), F.round(c, 9).desc(), "label"))
    rows = scores.withColumn("geometry", clip(F.col("geometry"), 0.0, 1.0))
    rows = rows.withColumn("re", rank("expert")).withColumn("rs", rank("expert", "seen")).withColumn("rg", rank("geometry")).withColumn("rp", rank("profile"))
    geo = lambda r: F.max(F.when((F.col("rs") == r) & F.col("seen"), F.col("geometry"))).over(by_row)
    rows = rows.withColumn("c", clip(F.coalesce(geo(1) - geo(2), F.lit(0.0)), 0.0, 1.0))
    best = lambda c: F.max(F.when(F.col(c) == 1, F.col("label"))).over(by_row)
    agree = (best("re") == best("rg")).cast("int") + (best("re") == best("rp")).cast("int") + (best("rg") == best("rp")).cast("int")
    rows = rows.withColumn("tier", F.when(agree == 3, "gold").when(agree >= 1, "silver").otherwise("bronze"))
    around = rows.where("re <= 3").select("id", "label").join(neighbours, "label").select("id", F.col("near").alias("label")).union(rows.where("re <= 3").select("id", "label")).distinct().withColumn("hop", F.lit(True))
    rows = rows.join(around, ["id", "label"], "left")
    keep = (F.col("geometry") >= GEOMETRY_SHARE * F.max("geometry").over(by_row)) | (F.col("rp") <= PROFILE_TOP) | F.col("hop")
    c = F.col("c")
    score = 0.8 * c * F.col("expert") + (0.1 * c + 0.6 * (1 - c)) * F.col("geometry") + (0.1 * c + 0.4 * (1 - c)) * F.col("profile")
    return rows.select("id", "label", F.when(keep, score).otherwise(0.0).alias("score"), "tier")


def score_entropy(scores: DataFrame) -> DataFrame:
    """(id, entropy) of long scores (id, label, score)."""
    n = F.count("*").over(Window.partitionBy("id"))
    p = (F.col("score") + 1e-15) / (F.sum("score").over(Window.partitionBy("id")) + 1e-15 * n)
    return scores.select("id", p.alias("p")).groupBy("id").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-9))).alias("entropy"))


def written(rows: DataFrame, results: DataFrame, prefix: str = "") -> DataFrame:
    """rows with the columns of results (one row per id) under a prefix; rows without a result have nulls."""
    named = results.select("id", *[F.col(c).alias(prefix + c) for c in results.columns if c != "id"])
    return rows.drop(*[c for c in named.columns if c != "id"]).join(named, "id", "left")


def one_hop(edges: DataFrame) -> DataFrame:
    """(label, near): parents, children and itself."""
    both = edges.select(F.col("child").alias("label"), F.col("parent").alias("near")).union(edges.select("parent", "child"))
    own = both.select("label", F.col("label").alias("near"))
    return both.union(own).distinct()


