"""Sources, preparation and whole analyses against brute force."""

import gzip
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.operators import doublets, graph, labels, ontology, preparation, simplify, stats, trajectory, trends
from quillstone.sources import discovery

DATA = "/root/testdata"


def write_matrix(folder, cells, genes, values, zipped=False):
    os.makedirs(folder)
    put = (lambda n, s: gzip.open(f"{folder}/{n}.gz", "wt").write(s)) if zipped else (lambda n, s: open(f"{folder}/{n}", "w").write(s))
    put("matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n" + f"{len(genes)} {len(cells)} {len(values)}\n" + "".join(f"{g} {c} {v}\n" for g, c, v in values))
    put("features.tsv", "".join(f"{g}\t{s}\tGene Expression\n" for g, s in genes))
    put("barcodes.tsv", "".join(f"{c}\n" for c in cells))


def test_runs_are_discovered_and_loaded(spark, tmp_path):
    write_matrix(tmp_path / "run/s1/outs/filtered_feature_bc_matrix", ["AA", "AC"], [("g1", "x"), ("g2", "")], [(1, 1, 3), (2, 2, 5)])
    write_matrix(tmp_path / "run/s1/outs/raw_feature_bc_matrix", ["AA"], [("g1", "x")], [(1, 1, 9)])
    write_matrix(tmp_path / "run/s2/outs/filtered_feature_bc_matrix", ["AA"], [("g2", "y"), ("g3", "z")], [(1, 1, 7)], zipped=True)
    os.makedirs(tmp_path / "run/s3")
    open(tmp_path / "run/s3/barcodes.tsv", "w").write("A\n")
    found, said = discovery.discover(str(tmp_path / "run"))
    assert [(c.sample, c.state) for c in found][:2] == [("s1", "filtered"), ("s2", "filtered")] and any("incomplete" in x and "s3" in x for x in said)
    expr, genes = discovery.load(spark, str(tmp_path / "run"))
    assert sorted(map(tuple, expr.collect())) == [("s1_AA", "g1", 3.0), ("s1_AC", "g2", 5.0), ("s2_AA", "g2", 7.0)]
    assert {r.gene: r.symbol for r in genes.collect()} == {"g1": "x", "g2": "y", "g3": "z"}
    assert discovery.discover(str(tmp_path / "none"))[0] == [] and discovery.sample_of("/a/per_sample_outs/p7/count/x") == ("p7", True)
    with pytest.raises(FileNotFoundError):
        discovery.load(spark, str(tmp_path / "run/s3"))
    names = discovery.unique(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "gene string, symbol string"))
    assert sorted(r.name for r in names.collect()) == ["a", "a-1", "b"]


def test_slots_and_species(spark):
    frame = lambda values: spark.createDataFrame([(float(v),) for v in values], "value double")
    logs = [math.log1p(v) for v in (0.3, 0.7, 1, 2, 5)] * 4
    assert preparation.expression_source([("counts", frame([-1, 2])), ("raw", frame(logs))])[::2] == ("raw", "log1p_like")
    with pytest.raises(ValueError):
        preparation.expression_source([("raw", frame(logs))], allow_log=False)
    genes = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    assert preparation.species(genes("ENSG1", "ENSMUSG1", "x")) == "human" and preparation.species(genes("ENSMUSG1.4")) == "mouse" and preparation.species(genes("x")) is None


def test_attaching_refuses_what_does_not_match(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError, match="no column"):
        labels.attach(rows, spark.createDataFrame([("z", 1.0)], "id string, v double"))
    with pytest.raises(ValueError, match="twice"):
        labels.attach(rows, spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, v double"))
    got = labels.attach(rows, spark.createDataFrame([("q", " a", 1.0)], "id string, other string, v double"))
    assert {r.id: r.v for r in got.collect()} == {"a": 1.0, "b": None}


def test_principal_components_are_those_of_the_covariance(spark):
    x = np.random.RandomState(0).standard_normal((60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    got = preparation.principal_components(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, z array<double>"), 3)
    z = np.array([r.z for r in got.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(z), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_doublets_are_called_in_each_batch(spark):
    r = random.Random(1)
    counts, cells = [], []
    for c in range(700):
        batch = "a" if c < 340 else "b" if c < 690 else "small"
        kinds = [c % 3] if c % 20 else [0, 1]
        cells.append((c, batch))
        counts += [(c, g, float(r.randint(1, 6))) for g in range(30) if g // 10 in kinds]
    counts, cells = spark.createDataFrame(counts, "cell long, gene long, value double"), spark.createDataFrame(cells, "cell long, batch string")
    got = {x.cell: x for x in preparation.detect_doublets(counts, cells, 0.08, "batch", components=5).collect()}
    assert all(not got[c].is_doublet and got[c].doublet_score == 0 for c in range(690, 700))
    for low, high in ((0, 340), (340, 690)):
        called = [c for c in range(low, high) if got[c].is_doublet]
        mixed = [c for c in range(low, high) if not c % 20]
        assert len(set(called) & set(mixed)) >= 0.9 * len(mixed) and 0.05 * 340 < len(called) < 0.15 * 340


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_approximate_neighbours_have_a_recall_of_nine_tenths(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))
    asked = rows.where("id % 20 = 0")
    exact = {(r.src, r.dst) for r in graph.nearest(asked, rows, 10).collect()}
    assert len(exact & {(r.src, r.dst) for r in graph.approximate(asked, rows, 10, bucket=64).collect()}) >= 0.9 * len(exact)


def test_names_decide_before_depths_and_gradients(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("c", "a", 3.0), ("d", "e", 4.0), ("e", "d", 5.0)], "a string, b string, weight double")
    depths = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1)], "node string, shortest int")
    names = spark.createDataFrame([("a", "early stem cell"), ("b", "cell"), ("c", "cell")], "node string, name string")
    gradients = spark.createDataFrame([("e", "d")], "source string, target string")
    got = sorted(map(tuple, trajectory.directed(pairs, depths, names, gradients).collect()))
    assert got == [("a", "b", 1.0, "name"), ("a", "c", 3.0, "name"), ("e", "d", 5.0, "gradient")]


def test_lineages_are_edited():
    assigned = {"t1": "A", "t2": "A", "t3": "B", "t4": "t4"}
    below = {"R": set(assigned), "A": {"t1", "t2"}, "t2": {"t2"}}
    above = {"t1": {"A", "R"}, "t2": {"A", "R"}, "t3": {"B", "R"}, "t4": {"R"}}
    depth = {"R": 0, "A": 1, "B": 1, "t1": 2, "t2": 2, "t3": 2, "t4": 1}
    edit = lambda *e: trajectory.edited_lineages(assigned, list(e), below, above, depth)
    assert edit("A + B") == {"t1": "R", "t2": "R", "t3": "R", "t4": "t4"}
    assert edit("t2") == {"t1": "A", "t2": "t2", "t3": "B", "t4": "t4"}
    for bad in (("A", "t2"), ("nothing",), (" + ",)):
        with pytest.raises(ValueError):
            edit(*bad)


def test_groups_are_bounded_as_a_whole():
    members = {"root": {f"t{i}" for i in range(10)}, "x": {f"t{i}" for i in range(8)}}
    assert set(simplify.covers(members, 2, 8).values()) == {"x"}  # the root has ten in all, though only two are left
    links = [("t8", "root"), ("root", "x"), ("t9", "far")]
    assert simplify.covers(members, 2, 8, links)["t8"] == "x" and "t9" not in simplify.covers(members, 2, 8, links)


def test_vocabularies_are_pruned_and_followed_up(spark):
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "q"), ("q", "r"), ("c", "r"), ("d", "a")], "child string, parent string")
    counts = spark.createDataFrame([("a", 9), ("b", 1), ("c", 5), ("d", 2)], "node string, n int")
    assert sorted(map(tuple, ontology.pruned(edges, counts, 4).collect())) == [("a", "r"), ("c", "r")]
    assert sorted(r.node for r in ontology.relevant(edges, counts.where("n = 2")).collect()) == ["a", "d", "p", "q", "r"]
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "child string, parent string")
    assert max(r.hops for r in ontology.hop_distances(long).collect()) == 12


def brute_verdict(rows, a, b, ratio, least):
    corr = lambda x, y: float(np.corrcoef(x, y)[0, 1])
    at = {k: [z for z, predicted, on, *_ in rows if predicted == k and not on] for k in (a, b)}
    if min(map(len, at.values())) < least:
        return "unreliable"
    mean = {k: np.mean(at[k], axis=0) for k in at}
    gap = lambda zs: np.array([corr(z, mean[b]) - corr(z, mean[a]) for z in zs])
    low, high = np.median(gap(at[a])), np.median(gap(at[b]))
    wide = lambda zs: float(np.subtract(*np.percentile((gap(zs) - low) / (high - low + 1e-12), [75, 25])))
    on = [z for z, _, _, moving, s, t in rows if moving and {s, t} == {a, b}]
    return "unreliable" if not on else "blob" if wide(on) / (np.median([wide(at[a]), wide(at[b])]) + 1e-12) < ratio else "spread"


def test_edges_that_are_no_wider_than_their_ends_are_blobs(spark):
    r = np.random.RandomState(2)
    centre = {k: r.standard_normal(8) * 2 for k in "abcd"}
    rows = [(centre[k] + r.standard_normal(8), k, False, False, k, None) for k in "abc" for _ in range(60)]
    for s, t, blob in (("a", "b", False), ("b", "c", True), ("c", "d", False)):
        for _ in range(40):
            w = 0.5 if blob else r.rand()
            rows.append(((1 - w) * centre[s] + w * centre[t] + 0.3 * r.standard_normal(8), s, True, True, s, t))
    df = spark.createDataFrame([(i, z.tolist(), *rest) for i, (z, *rest) in enumerate(rows)], "id long, z array<double>, predicted string, on_inferred boolean, moving boolean, source string, target string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "a string, b string")
    got = {(x.a, x.b): x.verdict for x in trajectory.spread_verdicts(df, edges).collect()}
    assert got == {e: brute_verdict(rows, *e, 1.5, 50) for e in got} and set(got.values()) == {"blob", "spread", "unreliable"}


def test_trends_of_a_lineage(spark):
    """Genes that change are found in the order of their peaks."""
    r = random.Random(3)
    counts, cells = [], []
    for c in range(240):
        t = c / 240
        cells.append((c, "x", float(c), float(r.choice((1, 2, 3))), "early" if t < 0.5 else "late"))
        level = {"rising": 20 * t, "falling": 20 * (1 - t), "middle": 20 * math.exp(-(((t - 0.5) / 0.15) ** 2))} | {f"flat{k}": 40.0 for k in range(30)}
        counts += [(c, g, float(v)) for g, x in level.items() if (v := round(x * r.uniform(0.7, 1.3)))]
    counts.append((5, "rare", 1.0))
    counts = spark.createDataFrame(counts, "id long, gene string, value double")
    cells = spark.createDataFrame(cells, "id long, lineage string, rank double, covariate double, type string")
    got = {x.gene: x for x in trends.gene_trends(counts, cells, keep_all=True).collect()}
    assert "rare" not in got and len(got) == 33
    assert {"rising", "falling", "middle"} <= {g for g, x in got.items() if x.q < 0.2} and sum(x.q < 0.2 for x in got.values()) < 12
    found = trends.gene_trends(counts, cells, fdr=0.2).orderBy("order_in_lineage").collect()
    order = [x.gene for x in found if x.gene in ("rising", "falling", "middle")]
    assert order == ["falling", "middle", "rising"] and {x.gene: x.type_at_peak for x in found}["rising"] == "late"


def test_markers_and_modules(spark):
    r = random.Random(4)
    rows = [(c, g, float(r.randint(0, 3) + 6 * (g == c % 3))) for c in range(120) for g in range(6)]
    rows += [(c, 10 + g, float(x + r.random())) for c in range(120) for x in [r.randint(0, 9)] for g in range(4)]
    expr = spark.createDataFrame(rows, "cell long, gene long, value double")
    own = spark.createDataFrame([(c, f"k{c % 3}", f"s{c % 4}") for c in range(120)], "cell long, label string, sample string")
    best = {x.label: x for x in stats.find_markers(expr, own, top=1).collect()}
    assert {k: x.gene for k, x in best.items()} == {"k0": 0, "k1": 1, "k2": 2} and all(x.basis == "across_sample" and x.p < 1e-3 and x.reproducibility == 1 for x in best.values())
    assert {x.basis for x in stats.find_markers(expr, own, confidence="within_sample").collect()} == {"within_sample"}
    masses = spark.createDataFrame([(g, 1.5) for g in range(20)], "gene long, mass double")
    sets = spark.createDataFrame([("t", g) for g in range(10, 14)] + [("u", g) for g in range(40)], "term string, gene long")
    edges, modules, terms = stats.gene_networks(expr, expr, 120, masses, sets, least=0.6)
    assert {(x.module, x.gene, x.mass) for x in modules.collect()} == {(10, g, 6.0) for g in range(10, 14)} and all(x.p < 1e-6 for x in edges.collect())
    assert [x.term for x in terms.collect()] == ["t"]


def test_inverted_lists_find_what_an_exact_search_finds(spark, monkeypatch):
    """Recall of doublets' larger search, equal rows in order of ids, and no bound on what is indexed."""
    r = np.random.RandomState(5)
    z = np.concatenate([r.standard_normal((9000, 8)), np.repeat(r.standard_normal((20, 8)), 150, axis=0)]).round(4)
    rows = spark.createDataFrame([(i if i % 3 else -i - 1, x) for i, x in enumerate(z.tolist())], "id long, z array<double>").repartition(6)
    asked = rows.where("id > 0 and id % 20 = 0")
    pairs = lambda src, row, rank, dst, sim: pd.DataFrame({"src": src[row], "rank": rank, "dst": dst, "sim": sim})
    found = lambda n: {(x.src, x.dst) for x in graph.indexed(asked, rows, 40, pairs, "src long, rank long, dst long, sim double", probes=n).collect()}
    exact = {(x.src, x.dst) for x in graph.nearest(asked, rows, 40, metric="euclidean", digits=3).collect()}
    some, whole = found(6), found(10**6)
    assert len(some) == len(whole) == len(exact) and len(exact & some) >= 0.9 * len(exact) and len(exact & whole) >= 0.995 * len(exact)
    sure = {x.id: x.pann for x in doublets.near_synthetic(rows, 40, 10, 30).collect()}
    monkeypatch.setattr(doublets, "EXACT_PAIRS", 0)
    near = {x.id: x.pann for x in doublets.near_synthetic(rows, 40, 10, 30).collect()}
    assert near.keys() == sure.keys() and np.mean([abs(near[i] - sure[i]) for i in sure]) < 0.02
