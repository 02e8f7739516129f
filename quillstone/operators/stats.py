"""Grouped statistics, ranks, and tests with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.tails import hypergeometric_upper, normal_upper, student_upper
from quillstone.operators.lineage import cut


def bh(rows: DataFrame, p: str = "p", by: list[str] | None = None, out: str = "q") -> DataFrame:
    """Adds Benjamini-Hochberg q within each group; a null p has a null q and does not count."""
    by = by or []
    keys = [F.col(c) for c in by]
    # one row per p: ties are one, and what a window orders is distinct values
    ps = rows.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p)).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy(F.col(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by).orderBy(F.col(p)).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ps = ps.withColumn("_m", F.sum("_n").over(Window.partitionBy(*by))).withColumn("_rank", F.sum("_n").over(up))
    ps = ps.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down)))
    named = ps.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(p).alias("_p"), out)
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col(p) == F.col("_p")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(named, condition, "left").drop("_p", *[f"_k_{c}" for c in by])


def average_rank(order: Column, by: list[str]) -> Column:
    """Average rank of ties within a group."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, order))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2


def pct_rank(rows: DataFrame, column: str, by: list[str], out: str = "pct") -> DataFrame:
    """Adds average rank over count within a group; a null has none and does not count."""
    v = F.col(column)
    some, none = rows.where(v.isNotNull()), rows.where(v.isNull())
    ranked = some.withColumn(out, average_rank(v, by) / F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.unionByName(none.withColumn(out, F.lit(None).cast("double")))


def label_sums(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, gene, s, ss, cells): sums and sums of squares of values, and the label's cells, with or without values."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("cells"))
    sums = expr.join(labels, "cell").groupBy("label", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    genes = expr.select("gene").distinct()
    grid = genes.join(F.broadcast(sizes))  # every gene with every label: the labels are few
    return grid.join(sums, ["label", "gene"], "left").fillna(0.0, ["s", "ss"])


def marker_scores(expr: DataFrame, labels: DataFrame, clip: float = 100.0) -> DataFrame:
    """(label, gene, mean, other, spec, contrast): the mean per label, against the largest of the other labels."""
    means = label_sums(expr, labels).select("label", "gene", (F.col("s") / F.col("cells")).alias("mean"))
    top = Window.partitionBy("gene").orderBy(F.desc("mean"), "label")
    two = means.withColumn("r", F.row_number().over(top)).where("r <= 2").groupBy("gene").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("mean"))).alias("high"), F.max(F.when(F.col("r") == 2, F.col("mean"))).alias("second"))
    out = means.join(two, "gene").withColumn("other", F.coalesce(F.when(F.col("label") == F.col("first"), F.col("second")).otherwise(F.col("high")), F.lit(0.0)))
    ratio = F.greatest("mean", F.lit(0.0)) / F.greatest(F.greatest("other", F.lit(0.0)), F.lit(1e-9))
    return out.select("label", "gene", "mean", "other", (F.col("mean") - F.col("other")).alias("spec"), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(clip)).alias("contrast"))


def welch(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, gene, z): each label against all other cells, unbiased variances; null below two cells on a side."""
    rows = label_sums(expr, labels)
    whole = Window.partitionBy("gene")
    rows = rows.withColumn("s2", F.sum("s").over(whole) - F.col("s")).withColumn("ss2", F.sum("ss").over(whole) - F.col("ss")).withColumn("n2", F.sum("cells").over(whole) - F.col("cells"))
    variance = lambda s, ss, n: F.greatest(F.col(ss) - F.col(s) * F.col(s) / F.col(n), F.lit(0.0)) / (F.col(n) - 1)
    se = F.sqrt(variance("s", "ss", "cells") / F.col("cells") + variance("s2", "ss2", "n2") / F.col("n2") + 1e-12)
    z = F.when((F.col("cells") >= 2) & (F.col("n2") >= 2), (F.col("s") / F.col("cells") - F.col("s2") / F.col("n2")) / se)
    return rows.select("label", "gene", z.alias("z"))


def one_vs_rest(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """welch with its upper-tail p, 1 where there is no z."""
    return welch(expr, labels).withColumn("p", F.when(F.col("z").isNull(), 1.0).otherwise(normal_upper("z")))


def permutation_test(expr: DataFrame, labels: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """(label, gene, mean, p): how often labels dealt anew by hash reach the mean; p = (reached + 1) / (n + 1)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("cells"))
    by_label = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.withColumn("low", F.coalesce(F.sum("cells").over(by_label), F.lit(0)))
    shuffles = labels.select("cell", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    placed = shuffles.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), "k", "cell"), "cell")) - 1)
    dealt = placed.join(F.broadcast(spans), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("cells")))
    observed = label_sums(expr, labels).select("label", "gene", (F.col("s") / F.col("cells")).alias("mean"))
    drawn = expr.join(dealt.select("cell", "k", "label", "cells"), "cell").groupBy("k", "label", "gene").agg((F.sum("value") / F.first("cells")).alias("drawn"))
    # a shuffle in which no cell of the label has the gene has mean 0, which reaches what is not above 0
    reached = observed.join(drawn, ["label", "gene"], "left").groupBy("label", "gene").agg(F.first("mean").alias("mean"), F.count_if(F.col("drawn") >= F.col("mean")).alias("up"), F.count("drawn").alias("seen"))
    up = F.col("up") + F.when(F.col("mean") <= 0, n - F.col("seen")).otherwise(0)
    return reached.select("label", "gene", "mean", ((up + 1) / (n + 1)).alias("p"))


def sample_effects(expr: DataFrame, labels: DataFrame, least: int = 10) -> DataFrame:
    """(label, gene, sample, effect): mean inside less mean outside the label, in samples with enough cells on both sides; labels: (cell, label, sample)."""
    sizes = labels.groupBy("sample", "label").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n2", F.sum("n").over(Window.partitionBy("sample")) - F.col("n"))
    sums = expr.join(labels, "cell").groupBy("sample", "label", "gene").agg(F.sum("value").alias("s"))
    sums = sums.withColumn("all", F.sum("s").over(Window.partitionBy("sample", "gene")))
    totals = sums.groupBy("sample", "gene").agg(F.first("all").alias("all"))
    grid = sizes.where((F.col("n") >= least) & (F.col("n2") >= least)).join(totals, "sample")
    rows = grid.join(sums.select("sample", "label", "gene", "s"), ["sample", "label", "gene"], "left").fillna(0.0, ["s"])
    return rows.select("label", "gene", "sample", (F.col("s") / F.col("n") - (F.col("all") - F.col("s")) / F.col("n2")).alias("effect"))


def across_samples(effects: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(label, gene, samples, effect, t, reproducibility): one-sample t of the effects, and the share above threshold."""
    rows = effects.groupBy("label", "gene").agg(
        F.count("*").alias("samples"), F.avg("effect").alias("effect"), F.stddev_samp("effect").alias("sd"),
        F.avg((F.col("effect") > threshold).cast("double")).alias("reproducibility"),
    )
    t = F.when((F.col("samples") >= 2) & (F.col("sd") > 0), F.col("effect") / (F.col("sd") / F.sqrt("samples")))
    return rows.select("label", "gene", "samples", "effect", t.alias("t"), "reproducibility")


def across_samples_p(effects: DataFrame) -> DataFrame:
    rows = across_samples(effects)
    return rows.withColumn("p", F.when(F.col("t").isNull(), 1.0).otherwise(student_upper("t", (F.col("samples") - 1).cast("double"))))


def marker_table(scores: DataFrame, top: int = 100, alpha: float | None = None) -> DataFrame:
    """Scores with spec > 0, and q below alpha where it is given, ranked within each label; at most `top`, the report's size."""
    rows = scores.where("spec > 0")
    if alpha is not None:
        rows = bh(rows, "p", ["label"]).where(F.col("q") < alpha)
    order = Window.partitionBy("label").orderBy(F.desc("spec"), *(["p"] if "p" in scores.columns else []), "gene")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def spearman_pairs(expr: DataFrame, genes: DataFrame, n_cells: int, least: float = 0.3) -> DataFrame:
    """(a, b, rho) for pairs of the chosen genes with abs(rho) >= least, over all cells, absent pairs 0; constant genes have none.

    Ranks of the zeros are one tie, so sums run over stored values alone; pairs meet in cells that have both.
    """
    held = expr.join(genes.select("gene").distinct(), "gene", "left_semi").where("value != 0").select("cell", "gene", "value")
    sizes = Window.partitionBy("gene")
    stored = held.withColumn("neg", F.count_if(F.col("value") < 0).over(sizes)).withColumn("zeros", n_cells - F.count("*").over(sizes))
    rank = average_rank(F.col("value"), ["gene"]) + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0)
    ranked = stored.select("cell", "gene", rank.alias("r"), "neg", "zeros")
    mean = (n_cells + 1) / 2
    ranked = ranked.withColumn("d", F.col("r") - mean).withColumn("z", F.col("neg") + (F.col("zeros") + 1) / 2 - mean)
    per_gene = ranked.groupBy("gene").agg(F.first("z").alias("z"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum("d").alias("d"), F.first("zeros").alias("zeros"))
    per_gene = per_gene.withColumn("ss", F.col("dd") + F.col("zeros") * F.col("z") * F.col("z")).where("ss > 1e-9")
    left, right = ranked.select("cell", F.col("gene").alias("a"), (F.col("d") - F.col("z")).alias("x")), ranked.select("cell", F.col("gene").alias("b"), (F.col("d") - F.col("z")).alias("y"))
    met = left.join(right, "cell").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    one = per_gene.select(F.col("gene").alias("a"), F.col("z").alias("za"), F.col("d").alias("da"), F.col("zeros").alias("na"), F.col("ss").alias("sa"))
    two = per_gene.select(F.col("gene").alias("b"), F.col("z").alias("zb"), F.col("d").alias("db"), F.col("zeros").alias("nb"), F.col("ss").alias("sb"))
    pairs = one.join(two, F.col("a") < F.col("b")).join(met, ["a", "b"], "left").fillna(0.0, ["xy"])
    # sum d_a d_b = sum (d_a - z_a)(d_b - z_b) + z_b sum d_a + z_a sum d_b - n z_a z_b, where sums of d over all cells are 0
    rho = (F.col("xy") - n_cells * F.col("za") * F.col("zb")) / F.sqrt(F.col("sa") * F.col("sb"))
    return pairs.select("a", "b", rho.alias("rho")).where(F.abs("rho") >= least - 1e-12)


def over_representation(chosen: DataFrame, sets: DataFrame, population: int) -> DataFrame:
    """(module, term, overlap, fold, p, q) of chosen (module, gene) against sets (term, gene): right tail, q within the module; no overlap, no row."""
    n = chosen.distinct().groupBy("module").agg(F.count("*").alias("n"))
    m = sets.distinct().groupBy("term").agg(F.count("*").alias("m"))
    a = chosen.distinct().join(sets.distinct(), "gene").groupBy("module", "term").agg(F.count("*").alias("overlap"))
    rows = a.join(n, "module").join(m, "term").withColumn("fold", F.col("overlap") / (F.col("n") * F.col("m") / population))
    return bh(rows.withColumn("p", hypergeometric_upper("overlap", F.lit(population), "m", "n")), "p", ["module"])


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, from the contingency table alone."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    index = cells.agg(two("n").alias("both"), F.sum("n").alias("all"))
    one = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("pa"))
    other = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("pb"))
    joined = index.join(F.broadcast(one)).join(F.broadcast(other))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    expected = F.col("pa") * F.col("pb") / pairs
    top = (F.col("pa") + F.col("pb")) / 2
    return joined.select(F.when((pairs > 0) & (top != expected), (F.col("both") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def find_markers(attributions: DataFrame, labels: DataFrame, top: int = 100, alpha: float | None = None, confidence: str = "auto", least: int = 10) -> DataFrame:
    """(label, gene, mean, spec, contrast, p, basis, reproducibility, rank): genes whose attribution is highest in a label, at most `top` of each, the report's size.

    attributions: (cell, gene, value), absent pairs 0; labels: (cell, label[, sample]). p: across samples
    where a label has two or more with cells enough on both sides (auto), else of each label against all other cells
    (within_sample), or by permutation.
    """
    if confidence not in ("auto", "within_sample", "permutation"):
        raise ValueError("confidence: auto, within_sample or permutation")
    plain = labels.select("cell", "label")
    scores = marker_scores(attributions, plain).select("label", "gene", "mean", "spec", "contrast")
    own = permutation_test(attributions, plain) if confidence == "permutation" else one_vs_rest(attributions, plain)
    rows = scores.join(own.select("label", "gene", F.col("p").alias("p_own")), ["label", "gene"])
    if confidence == "auto" and "sample" in labels.columns:
        across = across_samples_p(sample_effects(attributions, labels, least)).select("label", "gene", "samples", F.col("p").alias("p_across"), "reproducibility")
        rows = rows.join(across, ["label", "gene"], "left")
        many = F.coalesce(F.col("samples") >= 2, F.lit(False))
        rows = rows.select("label", "gene", "mean", "spec", "contrast", F.when(many, F.col("p_across")).otherwise(F.col("p_own")).alias("p"), F.when(many, "across_sample").otherwise("within_sample").alias("basis"), F.when(many, F.col("reproducibility")).alias("reproducibility"))
    else:
        rows = rows.select("label", "gene", "mean", "spec", "contrast", F.col("p_own").alias("p"), F.lit("within_sample").alias("basis"), F.lit(None).cast("double").alias("reproducibility"))
    return marker_table(rows, top, alpha)


def gene_networks(expr: DataFrame, genes: DataFrame, n_cells: int, masses: DataFrame, sets: DataFrame | None = None, least: float = 0.3, least_size: int = 3, fdr: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges (a, b, rho, p), modules (module, gene, mass) and enriched terms of the chosen genes.

    Edges: correlated pairs, p by Student's t times the number of pairs tested. Modules: communities of
    the edges with at least least_size genes, numbered by their smallest gene; mass: the sum of masses
    (gene, mass) over a module. Terms: over_representation of modules in sets (term, gene) with q below fdr.
    """
    from quillstone.operators.graph import communities

    chosen = cut(genes.select("gene").distinct())
    pairs = chosen.count() * (chosen.count() - 1) / 2
    edges = spearman_pairs(expr, chosen, n_cells, least)
    t = F.abs("rho") * F.sqrt((n_cells - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-12)))
    edges = cut(edges.withColumn("p", F.least(F.lit(1.0), 2 * pairs * student_upper(t, F.lit(float(n_cells - 2))))))
    found = communities(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("rho").alias("weight")), chosen.select(F.col("gene").alias("id"))).where("community >= 0")
    sizes = found.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= least_size)
    members = cut(found.join(sizes, "community").select(F.col("first").alias("module"), F.col("id").alias("gene")))
    mass = members.join(masses, "gene", "left").groupBy("module").agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"))
    modules = members.join(mass, "module")
    terms = None if sets is None else over_representation(members, sets, n_genes(sets, chosen)).where(F.col("q") < fdr)
    return edges, modules, terms


def n_genes(sets: DataFrame, chosen: DataFrame) -> int:
    """The population of an enrichment: all genes of the sets and the chosen ones."""
    return sets.select("gene").union(chosen.select("gene")).distinct().count()
