"""Worked values and properties of the core operators on small tables."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import tails
from quillstone.functions import vectors as V
from quillstone.operators import atypical, classify, expression, graph, labels, ontology, stats, trajectory, trends
from quillstone.sources import models, tables
from quillstone.streaming import live


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    one, two = df.select(V.cosine(a, b), V.distance(a, b), V.softmax(a), V.jensen_shannon(V.shares(a), V.shares(b)), V.entropy(a)).collect()
    assert one[0] == pytest.approx(0.96) and one[1] == pytest.approx(math.sqrt(2)) and sum(one[2]) == pytest.approx(1)
    assert two[0] == 0 and two[2] == [0.5, 0.5] and 0 <= two[3] <= 1 and one[4] == pytest.approx(-(3 / 7 * math.log(3 / 7) + 4 / 7 * math.log(4 / 7)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.data())
def test_hypergeometric_by_counting(n, data):
    m, d = data.draw(st.integers(0, n)), data.draw(st.integers(0, n))
    k = data.draw(st.integers(-1, n + 1))
    p = [math.comb(m, x) * math.comb(n - m, d - x) / math.comb(n, d) if 0 <= d - x <= n - m else 0 for x in range(m + 1)]
    assert tails.hypergeometric(k, n, m, d, True) == pytest.approx(sum(p[max(k, 0) :]), abs=1e-9)
    assert tails.hypergeometric(k, n, m, d, False) == pytest.approx(sum(p[: max(k + 1, 0)]), abs=1e-9)


def test_student_and_normal_tails(spark):
    df = spark.createDataFrame([(2.015, 5.0), (0.0, 3.0), (-2.015, 5.0)], "t double, n double")
    got = df.select(tails.student_upper("t", "n"), tails.normal_upper("t")).collect()
    assert [round(r[0], 4) for r in got] == [0.05, 0.5, 0.95] and got[1][1] == 0.5


def test_false_discovery_and_ranks(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5), (5, None)], "id int, p double")
    assert [r.q for r in stats.bh(df).orderBy("id").collect()] == [pytest.approx(x) if x else None for x in (0.04, 0.04, 0.04, 0.5, None)]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", None)], "g string, v int")
    assert sorted(r.pct for r in stats.pct_rank(df, "v", ["g"]).collect() if r.pct) == [0.25, 0.625, 0.625, 1.0]


def test_empty_cells_and_zeros_in_qc(spark):
    expr = spark.createDataFrame([(1, 1, 0.0), (1, 2, 4.0), (2, 50, 6.0)], "cell int, gene int, value double")
    got = {r.cell: r for r in expression.qc_metrics(expr, spark.range(1, 4).select(F.col("id").cast("int").alias("cell")), F.col("gene") == 50, 1, 1, 20).collect()}
    assert got[1].genes == 1 and got[2].marked_pct == 100 and not got[2].qc_pass and got[3].total == 0 and not got[3].qc_pass


def test_value_kinds(spark):
    kind = lambda vs: expression.classify_values(spark.createDataFrame([(float(v),) for v in vs], "value double")).first()["kind"]
    assert kind([1, 2, 3]) == "raw_counts" and kind([0.5, 1.2, 2.7]) == "log1p_like" and kind([-1, 2]) == "unsupported" and kind([0]) == "unsupported" and kind([0.5, 20.5]) == "unsupported"


def test_otsu_parts_two_heaps(spark):
    r = random.Random(0)
    rows = spark.createDataFrame([(r.gauss(m, 0.02),) for m in (0.2, 0.8) for _ in range(300)], "value double")
    assert 0.25 < expression.otsu(rows, classes=2)[0] < 0.75 and len(expression.otsu(rows)) == 2


EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]


def test_ontology_worked_values(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    wang = {(r.a, r.b): r.similarity for r in ontology.wang_similarity(edges).collect()}
    assert wang["b", "a"] == pytest.approx(1.8 / 2.8) and wang["a", "b"] == wang["b", "a"] and wang["e", "e"] == pytest.approx(1)
    pair = spark.createDataFrame([("b", "c"), ("e", "b")], "a string, b string")
    assert {(r.a, r.b): r.lca for r in ontology.lowest_common_ancestors(edges, pair).collect()} == {("b", "c"): "a", ("e", "b"): "b"}
    assert {r.node: (r.shortest, r.longest) for r in ontology.depths(edges).collect()}["e"] == (3, 3)
    assert sorted(r.path for r in ontology.unrolled(edges).collect()) == ["a", "a/b", "a/b/d", "a/b/d/e", "a/c", "a/c/d", "a/c/d/e"]


def test_prune_factors(spark):
    edges = spark.createDataFrame([(0, k + 1, 1.0) for k in range(7)], "src int, dst int, weight double")
    classes = spark.createDataFrame([(k, f"c{k}") for k in range(8)], "id int, label string")
    distances = spark.createDataFrame([("c0", f"c{k + 1}", d) for k, d in enumerate([0, 1, 2, 3, 4, 5, -1])], "a string, b string, d int")
    assert [round(r.weight, 9) for r in graph.ontology_pruned(edges, classes, distances).orderBy("dst").collect()] == [1.0, 0.8, 0.6, 0.4, 0.2]


def test_nearest_in_blocks_is_nearest(spark):
    r = np.random.default_rng(0)
    z = np.vstack([r.normal(size=(60, 5)), np.zeros((1, 5)), np.ones((2, 5))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    n = np.linalg.norm(z, axis=1, keepdims=True)
    u = z / np.where(n > 0, n, 1)
    sims = np.round(u @ u.T, 9)
    want = set()
    for i in range(len(z)):
        order = sorted((j for j in range(len(z)) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        want |= {(i, j, k + 1) for k, j in enumerate(order)}
    assert {(x.src, x.dst, x.rank) for x in graph.nearest(rows, rows, 4, block=16).collect()} == want


def test_communities_and_walks(spark):
    links = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(links, "src long, dst long, weight double"), spark.range(20)).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[10] and got[19] == -1
    assert trajectory.walk([("x", 0.0), ("y", 1.0), ("z", -1.0)], [("y", "x")]) == ["z", "y", "x"]
    with pytest.raises(ValueError):
        trajectory.walk([("x", 0.0), ("y", 1.0)], [("y", "x"), ("x", "y")])


def test_pagerank_rows(spark):
    m = graph.personalised_pagerank(np.array([[0, 0, 0], [1, 0, 0], [1, 0, 0]]))
    assert np.allclose(m.sum(axis=1), 1) and (m.argmax(axis=1) == np.arange(3)).all()


def test_rare_threshold_and_errors(spark):
    rows = spark.createDataFrame([("a",)] * 985 + [("b",)] * 5 + [("c",)] * 10, "label string")
    assert {r.label: r.bucket for r in labels.roll_up_rare(rows).distinct().collect()} == {"a": "a", "b": "Rare", "c": "c"}
    with pytest.raises(ValueError):
        labels.roll_up_rare(rows, pct=101)
    with pytest.raises(ValueError):
        labels.format_label(F.col("label"), F.col("label"), "other")


def test_mixture_finds_two_heaps():
    r = np.random.default_rng(1)
    fit = atypical.mixture(np.concatenate([r.normal(0.2, 0.03, 800), r.normal(0.7, 0.05, 200)]))
    big = fit["weight"] > 0.1
    assert sorted(np.round(fit["mean"][big], 1)) == [0.2, 0.7] or fit["weight"][np.abs(fit["mean"] - 0.7) < 0.15].sum() == pytest.approx(0.2, abs=0.05)


def test_splines_and_constant_genes(spark):
    b = trends.spline_basis(np.linspace(0, 1, 50), np.array([0.3, 0.6]))
    assert b.shape == (50, 6) and np.allclose(b.sum(axis=1), 1)
    rows = spark.createDataFrame([("l", i, i / 99, g, v) for i in range(100) for g, v in (("flat", 1.0), ("up", i / 99))], "lineage string, id int, rank double, gene string, value double")
    got = {r.gene: r for r in trends.walk_statistics(rows).collect()}
    assert got["flat"].statistic == 0 and got["up"].statistic > 3
    assert {r.gene: r.peak for r in trends.curves(rows, (4, 6)).collect()}["up"] == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%x\n2 2 2\n1 2 5\n2 1 7\n")
    (tmp_path / "f.tsv").write_text("g1\tA\ng2\tB\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    got = tables.market_matrix(spark, str(tmp_path / "m.mtx"), str(tmp_path / "f.tsv"), str(tmp_path / "b.tsv"), "s").collect()
    assert {tuple(r) for r in got} == {("s_c2", "g1", 5.0), ("s_c1", "g2", 7.0)}
    (tmp_path / "s.gmt").write_text("one\tGO:1\ta\tb\ntwo\tplain\tc\n\n")
    assert {(r.term, r.gene) for r in tables.gene_sets(spark, str(tmp_path / "s.gmt")).collect()} == {("GO:1", "a"), ("GO:1", "b"), ("two", "c")}
    (tmp_path / "v.obo").write_text("format-version: 1.2\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nis_a: X:1 ! root\nis_a: X:3\n")
    assert {tuple(r) for r in tables.vocabulary(spark, str(tmp_path / "v.obo")).collect()} == {("X:2", "X:1"), ("X:2", "X:3")}


def test_model_registry(tmp_path):
    (tmp_path / "m.bin").write_bytes(b"x")
    models.add(str(tmp_path / "m.bin"), "human", str(tmp_path / "cache"), "1")
    assert models.available(str(tmp_path / "cache")) == ["human"] and models.version("human", str(tmp_path / "cache")) == "1"
    found = models.find("human", str(tmp_path / "cache"))
    found.write_bytes(b"y")
    with pytest.raises(ValueError):
        models.find("human", str(tmp_path / "cache"))
    models.clear(path=str(tmp_path / "cache"))
    assert models.available(str(tmp_path / "cache")) == []


def test_rows_of_a_stream_are_classified(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.2, 1.0])], "id long, z array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    protos = classify.prototypes(spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, z array<double>"))
    stream = live.classified(spark.readStream.schema("id long, z array<double>").parquet(str(tmp_path / "in")), protos)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert {r.id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "x", 2: "y"}


def test_simplification_on_the_driver():
    from quillstone.operators import simplify

    d = 1 - np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert simplify.average_linkage(d, 0.3).tolist() == [0, 0, 2] and len(set(simplify.average_linkage(d, 1.0))) == 1
    assert simplify.covers({"x": {"a", "b", "c"}, "y": {"b", "c"}, "z": {"d"}}) == {"a": "x", "b": "x", "c": "x"}
    deep = simplify.elastic_depths([("b", "a"), ("c", "b")], {"a": 0, "b": 1, "c": 2}, {"a": 0.0, "b": 0.3, "c": 0.2})
    assert deep["a"] < deep["b"] < deep["c"]


def test_settings_are_checked():
    from quillstone.plans.compose import Settings

    with pytest.raises(ValueError):
        Settings(alpha=2)


@pytest.mark.parametrize("block", [3, 100])
def test_a_fingerprint_does_not_depend_on_blocks(spark, block):
    from hashlib import sha256

    ids = spark.range(25).withColumn("order", -F.col("id")).unionByName(spark.createDataFrame([(None, 1)], "id long, order long"))
    whole = "".join(f"{len(str(i))}:{i}" for i in reversed(range(25)))
    assert labels.fingerprint(ids, "id", ["order"], block).first().fingerprint == sha256(sha256(whole.encode()).hexdigest().encode()).hexdigest()
    assert [r.fingerprint for r in labels.fingerprint(ids.where("false"), "id", ["order"]).collect()] == [None]


@pytest.mark.parametrize("refine", [False, True])
def test_labels_of_score_zero_are_ranked_by_similarity(spark, refine):
    from quillstone.plans import compose

    protos = spark.createDataFrame([("a", [-1.0, 0.0]), ("b", [-0.1, -1.0])], "label string, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.2])], "id long, z array<double>")
    got = compose.predict(rows, protos, compose.Settings(neighbours=1), refine).where("rank = 1").collect()
    assert {(r.id, r.label) for r in got} == {(1, "b"), (2, "b")} and (refine or {r.score for r in got} == {0.0})


def test_binomial_tails_of_many_draws():
    def summed(k, n, p):
        logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p) for x in range(k, n + 1)]
        return max(logs) + math.log(math.fsum(math.exp(x - max(logs)) for x in logs))

    for n, p in ((1, 0.5), (7, 0.3), (400, 0.02), (3000, 0.5), (3000, 0.9)):
        for k in {1, n, *(max(1, min(n, int(n * p * f))) for f in (0.5, 0.9, 1, 1.01, 1.1, 2))}:
            assert tails.binomial_log(k, n, p) == pytest.approx(summed(k, n, p), abs=1e-8, rel=1e-9)
    assert tails.binomial_log(300_000_000, 900_000_000, 0.3) == pytest.approx(-2311735, rel=0.01) and tails.binomial_log(1, 900_000_000, 0.3) == 0


def test_a_search_deals_out_no_pairs(spark):
    from quillstone.operators import doublets

    r = np.random.default_rng(1)
    z = r.normal(size=(90, 4))
    rows = spark.createDataFrame([(i - 30, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    plan = graph.nearest(rows, rows, 5, block=8)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Generate", "Window", "CoGroup"))
    got = {x.id: (x.pann, x.dr) for x in doublets.near_synthetic(rows, 40, real=9, pann=20).collect()}
    for i in range(30, 90):
        near = sorted((j for j in range(90) if j != i), key=lambda j: (round(float(np.linalg.norm(z[i] - z[j])), 9), j))[:40]
        nth = [k for k, j in enumerate(near) if j >= 30][8:9] or [40]
        assert got[i - 30] == (pytest.approx(sum(j < 30 for j in near[:20]) / 20), sum(j < 30 for j in near[: nth[0]]))
    assert len(got) == 60
