"""Queries over the driver's tables, one per operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import atypical, classify, doublets, expression, graph, labels, ontology, simplify, stats, trajectory, trends
from quillstone.plans import compose
from quillstone.plans.testbed import COARSE, COUNTS, EDGES_SQL, EVENTS, EXPR, KNN, LABELS, NODES, PROTOS, ROWS, SIMS, UP, Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Testbed under its name, with its SQL."""

    def add(f: Callable[[Testbed], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Testbed(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


# --- classification: the flagship ---------------------------------------------------------------

TOP = f"WITH {ROWS}, {PROTOS}, {SIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, label) AS rank FROM sims)"


@query(TOP + " SELECT id, label, round(sim, 6) AS sim, rank FROM ranked WHERE rank <= 3")
def topk_classes(t: Testbed) -> DataFrame:
    return rounded(classify.top_k(classify.similarities(t.rows, classify.prototypes(t.rows)), 3, "sim", 9), "sim")


@query(
    TOP + """, best AS (SELECT a.id, a.label, a.sim, a.sim - b.sim AS margin FROM ranked a JOIN ranked b ON a.id = b.id AND a.rank = 1 AND b.rank = 2),
    n AS (SELECT label, count(*) AS n FROM best GROUP BY label), l AS (SELECT least(ceil(sum(n) * 5.0 / 100), 40) AS l FROM n)
    SELECT id, best.label, round(sim, 6) AS sim, round(margin, 6) AS margin, CASE WHEN n < l THEN 'Rare' ELSE best.label END AS bucket, n < l AS is_bucketed FROM best JOIN n USING (label), l"""
)
def classify_and_roll_up(t: Testbed) -> DataFrame:
    best = classify.classified(t.rows, classify.prototypes(t.rows))
    return rounded(labels.roll_up_rare(best, pct=5.0, most=40).select("id", "label", "sim", "margin", "bucket", "is_bucketed"), "sim", "margin")


@query(f"WITH {ROWS}, {PROTOS} SELECT label, i - 1 AS i, round(x, 6) AS x FROM means")
def class_prototypes(t: Testbed) -> DataFrame:
    return rounded(classify.prototypes(t.rows).select("label", F.posexplode("v").alias("i", "x")), "x")


SCORES = f"WITH {ROWS}, {PROTOS}, {SIMS}, scores AS (SELECT id, label, greatest(sim, 0) AS score FROM sims)"


def _scores(t: Testbed) -> DataFrame:
    return classify.similarities(t.rows, classify.prototypes(t.rows)).select("id", "label", F.greatest("sim", F.lit(0.0)).alias("score"))


@query(SCORES + ", p AS (SELECT id, (score + 1e-15) / (sum(score) OVER w + 1e-15 * count(*) OVER w) AS p FROM scores WINDOW w AS (PARTITION BY id)) SELECT id, round(-sum(p * ln(p + 1e-9)), 6) + 0.0 AS entropy FROM p GROUP BY id")
def score_entropy(t: Testbed) -> DataFrame:
    return rounded(classify.score_entropy(_scores(t)), "entropy")


@query(
    f"""WITH {ROWS}, {PROTOS}, {SIMS}, {EDGES_SQL},
    hop AS (SELECT child AS label, parent AS near FROM edges UNION SELECT parent, child FROM edges UNION SELECT child, child FROM edges),
    s AS (SELECT id, label, round(exp(sim) / 10, 9) AS expert, least(greatest(sim, 0), 1) AS geometry, greatest(sim, 0) * (1 + (id % 3)) / 3 AS profile, label != 'L9' AS seen FROM sims),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(expert, 9) DESC, label) AS re, row_number() OVER (PARTITION BY id ORDER BY seen DESC, round(expert, 9) DESC, label) AS rs,
        row_number() OVER (PARTITION BY id ORDER BY round(geometry, 9) DESC, label) AS rg, row_number() OVER (PARTITION BY id ORDER BY round(profile, 9) DESC, label) AS rp FROM s),
    c AS (SELECT *, least(greatest(coalesce(max(geometry) FILTER (rs = 1 AND seen) OVER w - max(geometry) FILTER (rs = 2 AND seen) OVER w, 0), 0), 1) AS c, max(geometry) OVER w AS top,
        max(label) FILTER (re = 1) OVER w AS be, max(label) FILTER (rg = 1) OVER w AS bg, max(label) FILTER (rp = 1) OVER w AS bp FROM r WINDOW w AS (PARTITION BY id)),
    around AS (SELECT DISTINCT id, near AS label FROM c JOIN hop USING (label) WHERE re <= 3)
    SELECT c.id, c.label, round(CASE WHEN geometry >= .85 * top OR rp <= 15 OR a.id IS NOT NULL THEN .8 * c * expert + (.1 * c + .6 * (1 - c)) * geometry + (.1 * c + .4 * (1 - c)) * profile ELSE 0 END, 6) AS score,
        CASE WHEN be = bg AND be = bp THEN 'gold' WHEN be = bg OR be = bp OR bg = bp THEN 'silver' ELSE 'bronze' END AS tier
    FROM c LEFT JOIN around a ON a.id = c.id AND a.label = c.label"""
)
def consensus_scores(t: Testbed) -> DataFrame:
    sims = classify.similarities(t.rows, classify.prototypes(t.rows))
    heads = sims.select("id", "label", F.round(F.exp("sim") / 10, 9).alias("expert"), F.col("sim").alias("geometry"), (F.greatest("sim", F.lit(0.0)) * (1 + F.col("id") % 3) / 3).alias("profile"), (F.col("label") != "L9").alias("seen"))
    return rounded(classify.consensus(heads, classify.one_hop(t.edges)), "score")


# --- measurements -------------------------------------------------------------------------------

QC = f"""WITH {EXPR}, s AS (SELECT cell, sum(value) AS total, count(*) FILTER (value != 0) AS genes, sum(CASE WHEN gene % 50 = 0 THEN value ELSE 0 END) AS marked FROM expr GROUP BY cell),
q AS (SELECT o_orderkey AS cell, coalesce(total, 0) AS total, coalesce(genes, 0) AS genes, CASE WHEN total > 0 THEN 100 * marked / total ELSE 0 END AS marked_pct FROM orders LEFT JOIN s ON s.cell = o_orderkey)"""


def _qc(t: Testbed) -> DataFrame:
    return rounded(expression.qc_metrics(t.expr, t.cells, F.col("gene") % 50 == 0, 50, 2, 20.0), "marked_pct")


@query(QC + " SELECT cell, total, genes, round(marked_pct, 6) AS marked_pct, total >= 50 AND genes >= 2 AND marked_pct <= 20 AS qc_pass FROM q")
def qc_metrics(t: Testbed) -> DataFrame:
    return _qc(t)


@query(QC + " SELECT cell, total, genes FROM q WHERE total >= 50 AND genes >= 2 AND marked_pct <= 20")
def qc_filter(t: Testbed) -> DataFrame:
    return _qc(t).where("qc_pass").select("cell", "total", "genes")


NORM = f"""WITH {EXPR}, s AS (SELECT cell, sum(value) AS total FROM expr GROUP BY cell), m AS (SELECT quantile_cont(total, 0.5) AS target FROM s),
n AS (SELECT cell, gene, ln(1 + value * (target / greatest(total, 1))) AS value FROM expr JOIN s USING (cell), m WHERE value > 0), k AS (SELECT quantile_cont(value, 0.995) AS cutoff FROM n)"""


@query(NORM + " SELECT cell, gene, round(value, 6) AS value FROM n")
def library_size_normalisation(t: Testbed) -> DataFrame:
    return rounded(expression.log_normalised(t.expr), "value")


@query(NORM + " SELECT round(cutoff, 6) AS cutoff FROM k")
def global_clip_cutoff(t: Testbed) -> DataFrame:
    return rounded(expression.clip_cutoff(expression.log_normalised(t.expr)), "cutoff")


@query(NORM + " SELECT cell, round(sum(least(value, cutoff)), 5) AS value, count(*) FILTER (value > cutoff) AS clipped FROM n, k GROUP BY cell")
def clipped_values(t: Testbed) -> DataFrame:
    n = expression.log_normalised(t.expr)
    both = n.withColumnRenamed("value", "raw").join(expression.clipped(n), ["cell", "gene"])
    return rounded(both.groupBy("cell").agg(F.sum("value").alias("value"), F.count_if(F.col("raw") > F.col("value")).alias("clipped")), "value", digits=5)


@query(f"WITH {EXPR} SELECT 'counts' AS input, count(*) AS n, round(avg((abs(value - round(value)) < 1e-6)::INT), 6) AS whole, 'raw_counts' AS kind FROM expr WHERE value != 0 UNION ALL SELECT 'prices', count(*), round(avg((abs(l_discount - round(l_discount)) < 1e-6)::INT), 6), CASE WHEN avg((abs(l_discount - round(l_discount)) < 1e-6)::INT) < .8 AND avg((l_discount > 0 AND l_discount < 1)::INT) >= .05 AND max(l_discount) <= 10 THEN 'log1p_like' ELSE 'unsupported' END FROM lineitem WHERE l_discount != 0")
def matrix_classifier(t: Testbed) -> DataFrame:
    two = [("counts", t.expr), ("prices", t.table("lineitem").select(F.col("l_discount").alias("value")))]
    one, other = (expression.classify_values(df).select(F.lit(n).alias("input"), "n", "whole", "kind") for n, df in two)
    return rounded(one.union(other), "whole")


@query("SELECT l_orderkey, l_linenumber, round(exp(least(greatest(l_quantity / 4, 0), 10)) - 1, 3) AS value FROM lineitem")
def back_calculation(t: Testbed) -> DataFrame:
    logs = t.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("value"))
    return rounded(expression.counts_from_log(logs), "value", digits=3)


@query(f"WITH {EXPR}, g AS (SELECT p_partkey + 7 AS gene FROM part), f AS (SELECT g.gene, e.gene IS NOT NULL AS here FROM g LEFT JOIN (SELECT DISTINCT gene FROM expr) e ON e.gene = g.gene) SELECT count(*) FILTER (here) AS found, count(*) AS required, round(100.0 * count(*) FILTER (here) / count(*), 6) AS pct FROM f")
def gene_coverage(t: Testbed) -> DataFrame:
    return rounded(expression.coverage(t.expr, t.table("part").select((F.col("p_partkey") + 7).alias("gene"))).select("found", "required", "pct"), "pct")


@query(f"WITH {EXPR}, g AS (SELECT p_partkey AS gene, max(p_size) AS pos FROM part WHERE p_size <= 25 GROUP BY 1) SELECT cell, pos, sum(value) AS value FROM expr JOIN g USING (gene) GROUP BY 1, 2")
def gene_reorder(t: Testbed) -> DataFrame:
    return expression.model_genes(t.expr, t.table("part").where("p_size <= 25").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("pos")))


@query(
    """WITH m AS (SELECT median(o_totalprice) AS m FROM orders), r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS rank FROM orders, m WHERE o_totalprice > m),
    e AS (SELECT v, rank, log10(rank) AS x, log10(v + 1e-10) AS y FROM r), n AS (SELECT max(x) AS x1, max(y) AS y0, min(y) AS y1 FROM e),
    d AS (SELECT v, rank, round(abs((y1 - y0) / (y1 - y0 + 1e-10) * x / (x1 + 1e-10) - x1 / (x1 + 1e-10) * (y - y0) / (y1 - y0 + 1e-10)), 9) AS d FROM e, n)
    SELECT v AS threshold FROM d ORDER BY d DESC, rank LIMIT 1"""
)
def knee_threshold(t: Testbed) -> DataFrame:
    return expression.knee(t.table("orders"), "o_totalprice")


# --- labels and keys ----------------------------------------------------------------------------


@query("WITH m AS (SELECT DISTINCT p_brand || '-' || p_size AS symbol, p_partkey AS gene FROM part), k AS (SELECT symbol, count(*) AS hits, min(gene) AS gene FROM m GROUP BY 1), w AS (SELECT DISTINCT p_brand || '-' || (p_size + 5) AS symbol FROM part) SELECT w.symbol, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN gene::VARCHAR ELSE '' END AS gene FROM w LEFT JOIN k USING (symbol)")
def symbol_mapping(t: Testbed) -> DataFrame:
    symbol = lambda n: F.concat_ws("-", "p_brand", (F.col("p_size") + n).cast("string")).alias("symbol")
    return labels.map_symbols(t.table("part").select(symbol(5)).distinct(), t.table("part").select(symbol(0), F.col("p_partkey").cast("string").alias("gene")))


LABELLED = "l AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' (NA:' || n_nationkey || ')' WHEN 1 THEN 'NA:' || n_nationkey WHEN 2 THEN n_name ELSE 'unknown ' || n_name END AS label FROM nation)"


def _labelled(t: Testbed) -> DataFrame:
    k = F.col("n_nationkey")
    term = F.concat(F.lit("NA:"), k)
    text = F.when(k % 4 == 0, F.concat("n_name", F.lit(" ("), term, F.lit(")"))).when(k % 4 == 1, term).when(k % 4 == 2, F.col("n_name")).otherwise(F.concat(F.lit("unknown "), F.col("n_name")))
    return t.table("nation").select(k.alias("k"), text.alias("label"))


@query(f"WITH {LABELLED} SELECT k, label, CASE WHEN regexp_matches(label, '\\([A-Z]+:\\d+\\)$') THEN regexp_extract(label, '\\(([A-Z]+:\\d+)\\)$', 1) WHEN regexp_matches(label, '^[A-Z]+:\\d+$') THEN label END AS term FROM l")
def label_parse(t: Testbed) -> DataFrame:
    return _labelled(t).withColumn("term", labels.parse_label(F.col("label")))


@query(f"WITH {LABELLED} SELECT k, label, CASE WHEN k % 4 < 3 AND k < 20 THEN 'NA:' || k END AS term FROM l")
def label_resolve(t: Testbed) -> DataFrame:
    terms = t.table("nation").where("n_nationkey < 20").select(F.concat(F.lit("NA:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return labels.resolve_labels(_labelled(t), terms).select("k", "label", "term")


@query("SELECT 'NA:' || n_nationkey AS id, n_name AS name, n_name || ' (NA:' || n_nationkey || ')' AS both_of FROM nation")
def label_format(t: Testbed) -> DataFrame:
    term = F.concat(F.lit("NA:"), "n_nationkey")
    return t.table("nation").select(labels.format_label(term, F.col("n_name")).alias("id"), labels.format_label(term, F.col("n_name"), "name").alias("name"), labels.format_label(term, F.col("n_name"), "both").alias("both_of"))


@query("WITH c AS (SELECT lang || '/' || source AS label, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT least(ceil(sum(n) / 100.0), 20) AS l FROM c) SELECT doc_id, lang || '/' || source AS label, CASE WHEN n < l THEN 'Rare' ELSE c.label END AS bucket, n < l AS is_bucketed FROM documents JOIN c ON c.label = lang || '/' || source, l")
def rare_rollup(t: Testbed) -> DataFrame:
    return labels.roll_up_rare(t.table("documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("label"))).select("doc_id", "label", "bucket", "is_bucketed")


@query("SELECT 'c_name' AS \"column\", round(avg(regexp_matches(c_name, '\\d+$')::INT), 6) AS share FROM customer UNION ALL SELECT 'c_mktsegment', round(avg(regexp_matches(c_mktsegment, '\\d+$')::INT), 6) FROM customer")
def id_column_detection(t: Testbed) -> DataFrame:
    return rounded(labels.matching_share(t.table("customer"), r"\d+$"), "share")


@query("SELECT 'c_custkey' AS \"column\", count(*) AS overlap, count(*) AS trimmed FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'padded', 0, count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def join_key_detection(t: Testbed) -> DataFrame:
    left = t.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit(" "), F.col("o_custkey")).alias("padded"))
    return labels.key_overlap(left, t.table("customer").where("c_custkey % 2 = 0"), ["c_custkey", "padded"], "c_custkey")


@query(
    """WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i))
    SELECT p_partkey, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])), 4294967295) % 5 AS fold FROM part, tab"""
)
def crc_folds(t: Testbed) -> DataFrame:
    return t.table("part").select("p_partkey", labels.folds(F.col("p_name")).alias("fold"))


@query("WITH s AS (SELECT string_agg(length(c_custkey::VARCHAR) || ':' || c_custkey, '' ORDER BY c_custkey) AS s FROM customer) SELECT sha256(sha256(s)) AS fingerprint FROM s")
def cell_fingerprint(t: Testbed) -> DataFrame:
    return labels.fingerprint(t.table("customer"), "c_custkey", ["c_custkey"])


# --- neighbours and graphs ------------------------------------------------------------------------


def _knn(t: Testbed, k: int = 10) -> DataFrame:
    return graph.nearest(t.rows, t.rows, k)


@query(f"WITH {ROWS}, {KNN} SELECT src, dst, rank, round(sim, 6) AS sim FROM knn")
def cosine_knn(t: Testbed) -> DataFrame:
    return rounded(_knn(t), "sim")


@query(f"WITH {ROWS}, k AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.z, b.z), 9) DESC, b.id) AS rank FROM rows a JOIN rows b ON b.id % 5 = 0 AND a.id != b.id) SELECT src, dst, rank::INT AS rank FROM k WHERE rank <= 5 UNION ALL SELECT id, id, 0 FROM rows")
def anchor_knn(t: Testbed) -> DataFrame:
    near = graph.nearest(t.rows, t.rows.where("id % 5 = 0"), 5).select("src", "dst", "rank")
    return near.union(t.rows.select("id", "id", F.lit(0)))


SNN = f"""{ROWS}, {KNN}, links AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), deg AS (SELECT src, count(*) AS n FROM links GROUP BY 1),
met AS (SELECT a.src AS u, b.src AS v, count(*) AS c FROM links a JOIN links b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2),
snn AS (SELECT u AS src, v AS dst, c / (x.n + y.n - c) AS weight FROM met JOIN deg x ON x.src = u JOIN deg y ON y.src = v WHERE c / (x.n + y.n - c) >= 0.1)"""


@query(f"WITH {SNN} SELECT src, dst, round(weight, 6) AS weight FROM snn")
def snn_jaccard(t: Testbed) -> DataFrame:
    return rounded(graph.shared_neighbours(_knn(t)), "weight")


DIST = f"""{UP}, near AS (SELECT a.node AS a, b.node AS b, min(greatest(a.shortest, b.shortest)) AS d FROM up a JOIN up b ON a.ancestor = b.ancestor JOIN depth ON depth.node = a.ancestor WHERE depth.shortest >= 1 GROUP BY 1, 2),
dist AS (SELECT x.node AS a, y.node AS b, coalesce(d, -1) AS d FROM nodes x CROSS JOIN nodes y LEFT JOIN near ON near.a = x.node AND near.b = y.node)"""


@query(f"WITH RECURSIVE {DIST} SELECT * FROM dist")
def leaf_distance(t: Testbed) -> DataFrame:
    return ontology.leaf_distances(t.edges, 1)


@query(f"WITH RECURSIVE {SNN}, {DIST} SELECT src, dst, round(weight * (5 - d) / 5, 6) AS weight FROM snn JOIN rows x ON x.id = src JOIN rows y ON y.id = dst JOIN dist ON a = x.label AND b = y.label WHERE d BETWEEN 0 AND 4")
def snn_ontology_prune(t: Testbed) -> DataFrame:
    return rounded(graph.ontology_pruned(graph.shared_neighbours(_knn(t)), t.rows.select("id", "label"), ontology.leaf_distances(t.edges, 1)), "weight")


_ROUND = "m{k} AS (SELECT src AS id, label, sum(weight * z) AS w FROM adj JOIN z{j} z ON z.id = dst GROUP BY 1, 2), y{k} AS (SELECT p.id, p.label, .8 * p + .2 * coalesce(w, 0) AS z FROM p LEFT JOIN m{k} m ON m.id = p.id AND m.label = p.label), z{k} AS (SELECT id, label, z / (sum(z) OVER (PARTITION BY id) + 1e-10) AS z FROM y{k})"


@query(
    SCORES.replace("WITH ", f"WITH {SNN}, ", 1).replace(f"{ROWS}, {PROTOS}", PROTOS, 1)
    + """, sym AS (SELECT src, dst, weight FROM snn UNION ALL SELECT dst, src, weight FROM snn UNION ALL SELECT id, id, 1 FROM rows), dg AS (SELECT src, sum(weight) AS d FROM sym GROUP BY 1),
    adj AS (SELECT s.src, s.dst, weight / sqrt(a.d * b.d) AS weight FROM sym s JOIN dg a ON a.src = s.src JOIN dg b ON b.src = s.dst),
    p AS (SELECT id, label, (score + 1e-15) / sum(score + 1e-15) OVER (PARTITION BY id) AS p FROM scores), z0 AS (SELECT id, label, p AS z FROM p), """
    + ", ".join(_ROUND.format(k=k, j=k - 1) for k in (1, 2, 3))
    + " SELECT s.id, s.label, round(CASE WHEN s.id % 3 = 0 THEN z ELSE score END, 6) AS score FROM scores s JOIN z3 z ON z.id = s.id AND z.label = s.label"
)
def graph_propagation(t: Testbed) -> DataFrame:
    adjacency = graph.normalised(graph.shared_neighbours(_knn(t)), t.rows.select("id"))
    return rounded(graph.propagated(_scores(t), adjacency, uncertain=t.rows.where("id % 3 = 0")), "score")


@query(f"WITH {ROWS}, {KNN} SELECT src AS id, round(stddev_pop(list_sum(z)), 6) AS spread FROM knn JOIN rows ON rows.id = dst GROUP BY 1")
def neighbour_spread(t: Testbed) -> DataFrame:
    values = t.rows.select("id", F.aggregate("z", F.lit(0.0), lambda s, x: s + x).alias("value"))
    return rounded(graph.spread(values, _knn(t)), "spread")


@query()
def snn_communities(t: Testbed) -> DataFrame:
    if t.spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir")
    return graph.communities(graph.shared_neighbours(_knn(t)), t.rows)


@query("WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS m FROM c), y AS (SELECT sum(n * (n - 1) / 2) AS pa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), w AS (SELECT sum(n * (n - 1) / 2) AS pb FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((i - pa * pb / (m * (m - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (m * (m - 1) / 2)), 9) AS ari FROM x, y, w")
def adjusted_rand_index(t: Testbed) -> DataFrame:
    return rounded(stats.adjusted_rand(t.table("orders"), "o_orderpriority", "o_orderstatus"), "ari", digits=9)


# --- vocabulary ---------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {UP} SELECT * FROM up")
def ontology_closure(t: Testbed) -> DataFrame:
    return ontology.closure(t.edges)


@query(f"WITH RECURSIVE {UP} SELECT * FROM depth")
def ontology_depths(t: Testbed) -> DataFrame:
    return ontology.depths(t.edges)


@query(f"WITH RECURSIVE {UP}, c AS (SELECT a.node AS a, b.node AS b, a.ancestor, row_number() OVER (PARTITION BY a.node, b.node ORDER BY d.longest DESC, a.ancestor) AS r FROM up a JOIN up b ON a.ancestor = b.ancestor JOIN depth d ON d.node = a.ancestor) SELECT a, b, ancestor AS lca FROM c WHERE r = 1")
def lowest_common_ancestor(t: Testbed) -> DataFrame:
    n = ontology.nodes(t.edges)
    return ontology.lowest_common_ancestors(t.edges, n.select(F.col("node").alias("a")).crossJoin(n.select(F.col("node").alias("b"))))  # nodes of the vocabulary alone


@query(f"WITH RECURSIVE {UP}, s AS (SELECT node, ancestor, pow(.8, shortest) AS s FROM up), w AS (SELECT node, sum(s) AS t FROM s GROUP BY 1), h AS (SELECT a.node AS a, b.node AS b, sum(a.s + b.s) AS h FROM s a JOIN s b ON a.ancestor = b.ancestor GROUP BY 1, 2) SELECT a, b, round(h / (x.t + y.t), 6) AS similarity FROM h JOIN w x ON x.node = a JOIN w y ON y.node = b")
def wang_similarity(t: Testbed) -> DataFrame:
    return rounded(ontology.wang_similarity(t.edges), "similarity")


@query(f"WITH RECURSIVE {UP}, f AS (SELECT up.node, ancestor, row_number() OVER (PARTITION BY up.node ORDER BY d.shortest DESC, up.shortest, ancestor) AS r FROM up JOIN depth d ON d.node = ancestor WHERE d.shortest <= 1) SELECT node, ancestor AS target FROM f WHERE r = 1")
def level_rollup(t: Testbed) -> DataFrame:
    return ontology.level_rollup(t.edges, 1)


JOINING = f"{UP}, {COUNTS}, live AS (SELECT DISTINCT ancestor AS child FROM up JOIN counts ON counts.node = up.node WHERE n > 0), joining AS (SELECT parent AS node, count(*) AS supported FROM edges JOIN live USING (child) GROUP BY 1 HAVING count(*) >= 2 OR parent IN (SELECT node FROM roots))"


@query(f"WITH RECURSIVE {JOINING} SELECT * FROM joining")
def joining_ancestors(t: Testbed) -> DataFrame:
    return ontology.joining_ancestors(t.edges, t.counts)


@query(f"WITH RECURSIVE {JOINING}, lim AS (SELECT median(n) AS l FROM counts), good AS (SELECT node FROM counts, lim WHERE n >= l UNION SELECT node FROM joining), f AS (SELECT u.node, u.ancestor, row_number() OVER (PARTITION BY u.node ORDER BY u.shortest, u.ancestor) AS r FROM up u JOIN counts c ON c.node = u.node JOIN good g ON g.node = u.ancestor, lim WHERE u.shortest > 0 AND n < l) SELECT c.node, coalesce(ancestor, c.node) AS target FROM counts c LEFT JOIN f ON f.node = c.node AND r = 1")
def rare_class_fold(t: Testbed) -> DataFrame:
    least = t.counts.agg(F.percentile("n", F.lit(0.5))).first()[0]
    return ontology.fold_rare(t.edges, t.counts, least)


@query(f"WITH {EDGES_SQL}, {NODES}, leaf AS (SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM edges)) SELECT DISTINCT x.child AS a, y.child AS b FROM edges x JOIN edges y ON x.parent = y.parent AND x.child < y.child WHERE x.child IN (SELECT node FROM leaf) AND y.child IN (SELECT node FROM leaf)")
def terminal_siblings(t: Testbed) -> DataFrame:
    return ontology.terminal_siblings(t.edges)


@query(f"WITH RECURSIVE {UP}, {COUNTS} SELECT ancestor AS node, count(*) AS descendants, count(*) FILTER (n > 0) AS active, coalesce(sum(n), 0)::BIGINT AS n FROM up LEFT JOIN counts ON counts.node = up.node GROUP BY 1")
def active_descendants(t: Testbed) -> DataFrame:
    return ontology.active_counts(t.edges, t.counts)


@query(f"WITH RECURSIVE {UP}, tree(path, node, parent, depth) AS (SELECT node, node, NULL::VARCHAR, 0 FROM roots UNION ALL SELECT path || '/' || child, child, node, depth + 1 FROM tree JOIN edges e ON e.parent = tree.node) SELECT * FROM tree")
def tree_unroll(t: Testbed) -> DataFrame:
    return ontology.unrolled(t.edges)


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES}, both_of AS (SELECT child AS x, parent AS y FROM edges UNION SELECT parent, child FROM edges), way(a, b, hops) AS (SELECT node, node, 0 FROM nodes UNION SELECT a, y, hops + 1 FROM way JOIN both_of ON x = b WHERE hops < (SELECT count(*) FROM nodes)) SELECT a, b, min(hops) AS hops FROM way GROUP BY 1, 2")
def hop_distance(t: Testbed) -> DataFrame:
    return ontology.hop_distances(t.edges)


@query(f"WITH RECURSIVE {UP}, occ AS (SELECT node FROM nodes WHERE node NOT IN ('E', 'L3')) SELECT ancestor AS earlier, node AS later FROM up WHERE shortest > 0 AND node IN (SELECT node FROM occ) AND ancestor IN (SELECT node FROM occ) UNION SELECT 'L0', 'L1'")
def order_constraints(t: Testbed) -> DataFrame:
    occupied = ontology.nodes(t.edges).where("node not in ('E', 'L3')")
    return ontology.order_constraints(t.edges, occupied, t.spark.createDataFrame([("L0", "L1"), ("L3", "L1")], "earlier string, later string"))


# --- statistics -----------------------------------------------------------------------------------


@query("SELECT p_partkey, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (PARTITION BY p_brand ORDER BY p DESC)), 6) AS q FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, count(*) OVER (PARTITION BY p_brand ORDER BY p) AS r FROM (SELECT p_partkey, p_brand, pow((p_retailprice % 97) / 97, 3) AS p FROM part))")
def bh_fdr(t: Testbed) -> DataFrame:
    rows = t.table("part").select("p_partkey", "p_brand", F.pow((F.col("p_retailprice") % 97) / 97, F.lit(3)).alias("p"))
    return rounded(stats.bh(rows, "p", ["p_brand"]).select("p_partkey", "p", "q"), "p", "q")


@query("SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 9) AS pct FROM part")
def lineage_pct_rank(t: Testbed) -> DataFrame:
    return rounded(stats.pct_rank(t.table("part"), "p_size", ["p_brand"]).select("p_partkey", "pct"), "pct", digits=9)


SUMS = f"""WITH {COARSE}, {LABELS}, size AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), s AS (SELECT label, gene, sum(value) AS s, sum(value * value) AS ss FROM coarse JOIN lab USING (cell) GROUP BY 1, 2),
g AS (SELECT gene, size.label, n, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss FROM (SELECT DISTINCT gene FROM coarse) x CROSS JOIN size LEFT JOIN s USING (gene, label))"""


@query(SUMS + ", m AS (SELECT label, gene, s / n AS mean FROM g), o AS (SELECT a.label, a.gene, a.mean, max(b.mean) AS other FROM m a JOIN m b ON a.gene = b.gene AND a.label != b.label GROUP BY 1, 2, 3) SELECT label, gene, round(mean, 6) AS mean, round(other, 6) AS other, round(mean - other, 6) AS spec, round(least(greatest(mean, 0) / greatest(other, 1e-9), 100), 6) AS contrast FROM o")
def marker_spec_contrast(t: Testbed) -> DataFrame:
    return rounded(stats.marker_scores(t.coarse, t.labels), "mean", "other", "spec", "contrast")


@query(SUMS + ", m AS (SELECT label, gene, s / n AS mean FROM g), o AS (SELECT a.label, a.gene, a.mean - max(b.mean) AS spec FROM m a JOIN m b ON a.gene = b.gene AND a.label != b.label GROUP BY a.label, a.gene, a.mean), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(spec, 9) DESC, gene) AS rank FROM o WHERE spec > 0) SELECT label, gene, round(spec, 6) AS spec, rank FROM r WHERE rank <= 5")
def marker_table(t: Testbed) -> DataFrame:
    scores = rounded(stats.marker_scores(t.coarse, t.labels).select("label", "gene", "spec"), "spec", digits=9)
    return rounded(stats.marker_table(scores, 5), "spec")


@query(SUMS + ", a AS (SELECT *, sum(s) OVER w - s AS s2, sum(ss) OVER w - ss AS ss2, sum(n) OVER w - n AS n2 FROM g WINDOW w AS (PARTITION BY gene)) SELECT label, gene, round((s / n - s2 / n2) / sqrt(greatest(ss - s * s / n, 0) / (n - 1) / n + greatest(ss2 - s2 * s2 / n2, 0) / (n2 - 1) / n2 + 1e-12), 6) AS z FROM a")
def welch_statistic(t: Testbed) -> DataFrame:
    return rounded(stats.welch(t.coarse, t.labels), "z")


EFFECTS = f"""WITH {COARSE}, {LABELS}, sz AS (SELECT sample, label, count(*) AS n FROM lab GROUP BY 1, 2), sz2 AS (SELECT *, sum(n) OVER (PARTITION BY sample) - n AS n2 FROM sz),
s AS (SELECT sample, label, gene, sum(value) AS s FROM coarse JOIN lab USING (cell) GROUP BY 1, 2, 3), a AS (SELECT sample, gene, sum(s) AS a FROM s GROUP BY 1, 2),
eff AS (SELECT sz2.label, a.gene, sz2.sample, coalesce(s, 0) / n - (a - coalesce(s, 0)) / n2 AS effect FROM sz2 JOIN a USING (sample) LEFT JOIN s ON s.sample = sz2.sample AND s.label = sz2.label AND s.gene = a.gene WHERE n >= 10 AND n2 >= 10)"""


@query(EFFECTS + " SELECT label, gene, count(*) AS samples, round(avg(effect), 6) AS effect, round(avg(effect) / (stddev_samp(effect) / sqrt(count(*))), 5) AS t, round(avg((effect > 0)::INT), 6) AS reproducibility FROM eff GROUP BY 1, 2")
def across_samples(t: Testbed) -> DataFrame:
    return rounded(rounded(stats.across_samples(stats.sample_effects(t.coarse, t.sampled)), "effect", "reproducibility"), "t", digits=5)


@query(
    f"""WITH {COARSE}, n AS (SELECT count(*) AS n FROM orders), g AS (SELECT x.gene, o_orderkey AS cell, coalesce(value, 0) AS value FROM (SELECT DISTINCT gene FROM coarse) x CROSS JOIN orders LEFT JOIN coarse ON coarse.gene = x.gene AND coarse.cell = o_orderkey"""
    + """), r AS (SELECT gene, cell, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM g)
    SELECT a.gene AS a, b.gene AS b, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2 HAVING abs(corr(a.r, b.r)) >= 0.001"""
)
def spearman_edges(t: Testbed) -> DataFrame:
    return rounded(stats.spearman_pairs(t.coarse, t.coarse, t.cells.count(), 0.001), "rho")


_HYPER = "exp(lgamma({m} + 1) - lgamma(x + 1) - lgamma({m} - x + 1) + lgamma({n} - {m} + 1) - lgamma({d} - x + 1) - lgamma({n} - {m} - {d} + x + 1) - lgamma({n} + 1) + lgamma({d} + 1) + lgamma({n} - {d} + 1))"
SETS = "chosen AS (SELECT DISTINCT p_brand AS module, p_partkey AS gene FROM part WHERE p_size <= 10), sets AS (SELECT DISTINCT p_type AS term, p_partkey AS gene FROM part)"


@query(
    f"WITH {SETS}, pop AS (SELECT count(*) AS n FROM part), a AS (SELECT module, term, count(*) AS overlap FROM chosen JOIN sets USING (gene) GROUP BY 1, 2), d AS (SELECT module, count(*) AS d FROM chosen GROUP BY 1), m AS (SELECT term, count(*) AS m FROM sets GROUP BY 1), j AS (SELECT * FROM a JOIN d USING (module) JOIN m USING (term), pop), x AS (SELECT module, term, overlap, d, m, n, unnest(range(greatest(overlap, d + m - n), least(m, d) + 1)) AS x FROM j), y AS ("
    + f" SELECT module, term, any_value(overlap) AS overlap, any_value(overlap / (d * m / n)) AS fold, least(1, sum({_HYPER.format(m='m', n='n', d='d')})) AS p FROM x GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY module) AS k, count(*) OVER (PARTITION BY module ORDER BY p) AS r FROM y)"
    + " SELECT module, term, overlap, round(fold, 6) AS fold, round(p, 6) AS p, round(least(1, min(p * k / r) OVER (PARTITION BY module ORDER BY p DESC)), 6) AS q FROM r"
)
def set_over_representation(t: Testbed) -> DataFrame:
    part = t.table("part")
    rows = stats.over_representation(part.where("p_size <= 10").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("gene")), part.select(F.col("p_type").alias("term"), F.col("p_partkey").alias("gene")), part.count())
    return rounded(rows.select("module", "term", "overlap", "fold", "p", "q"), "fold", "p", "q")


@query()
def marker_permutation(t: Testbed) -> DataFrame:
    return rounded(stats.permutation_test(t.coarse, t.labels), "mean", "p")


# --- atypical rows --------------------------------------------------------------------------------

ADH = f"WITH {ROWS}, {PROTOS}, {SIMS}, near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, label) AS r FROM sims), e AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY id)) / .1) AS e FROM near WHERE r <= 5), w AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS weight FROM e)"


def _sims(t: Testbed) -> DataFrame:
    return classify.similarities(t.rows, classify.prototypes(t.rows))


@query(ADH + " SELECT id, label, round(weight, 6) AS weight, round(max(weight) OVER (PARTITION BY id), 6) AS adherence FROM w")
def softmax_adherence(t: Testbed) -> DataFrame:
    return rounded(atypical.adherence(_sims(t), 5), "weight", "adherence")


JSD = f"WITH {ROWS}, {PROTOS}, {SIMS}, e AS (SELECT id, label, own, sim, exp((sim - max(sim) OVER w) / .1) AS e, greatest(sim, 0) AS s FROM sims WINDOW w AS (PARTITION BY id)), pq AS (SELECT id, (e / sum(e) OVER w + 1e-12) / (1 + 1e-12 * count(*) OVER w) AS p, (CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1 / count(*) OVER w END + 1e-12) / (1 + 1e-12 * count(*) OVER w) AS q FROM e WINDOW w AS (PARTITION BY id)), jsd AS (SELECT id, least(greatest(sum(p * log2(2 * p / (p + q)) / 2 + q * log2(2 * q / (p + q)) / 2), 0), 1) AS jsd FROM pq GROUP BY id)"


@query(JSD + " SELECT id, round(jsd, 6) AS jsd FROM jsd")
def js_divergence(t: Testbed) -> DataFrame:
    return rounded(atypical.divergence(_sims(t), _scores(t)), "jsd")


def _features(t: Testbed) -> DataFrame:
    adh = atypical.adherence(_sims(t)).select("id", "adherence").distinct()
    return classify.classified(t.rows, classify.prototypes(t.rows)).join(adh, "id").join(atypical.divergence(_sims(t), _scores(t)), "id")


@query(JSD + ", rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, label) AS r FROM e), f AS (SELECT id, max(e) / sum(e) AS adh, max(sim) FILTER (r = 1) AS sim, max(sim) FILTER (r = 1) - max(sim) FILTER (r = 2) AS margin FROM rk GROUP BY id) SELECT id, round(((1 - adh) + jsd + (1 - sim) / 2 + least(greatest((1 - margin) / 2, 0), 1)) / 4, 6) AS abnormality FROM f JOIN jsd USING (id)")
def abnormality(t: Testbed) -> DataFrame:
    return rounded(atypical.abnormality(_features(t)).select("id", "abnormality"), "abnormality")


_REF = "c{k} AS (SELECT label, count(*) AS n, median(value) AS c FROM {src} GROUP BY 1), f{k} AS (SELECT s.label, any_value(n) AS n, any_value(c) AS c, 1.4826 * median(c - value) FILTER (value <= c) AS s FROM {src} s JOIN c{k} ON c{k}.label = s.label GROUP BY 1)"
REF = "v AS (SELECT c_mktsegment || c_nationkey AS label, c_acctbal / 10000 AS value FROM customer), " + _REF.format(k=1, src="v") + ", l AS (SELECT v.* FROM v JOIN f1 USING (label) WHERE n >= 10 AND s > 1e-4 AND (value - c) / s >= -2.5), " + _REF.format(k=2, src="l")


@query(f"WITH {REF} SELECT f1.label, f1.n, CASE WHEN f2.n >= 8 AND f2.s > 1e-4 THEN round(f2.c, 6) END AS centre, CASE WHEN f2.n >= 8 AND f2.s > 1e-4 THEN round(f2.s, 6) END AS scale, coalesce(f2.n >= 8 AND f2.s > 1e-4, false) AS valid FROM f1 LEFT JOIN f2 USING (label)")
def class_references(t: Testbed) -> DataFrame:
    rows = t.table("customer").select(F.concat("c_mktsegment", "c_nationkey").alias("label"), (F.col("c_acctbal") / 10000).alias("value"))
    return rounded(atypical.class_references(rows, 10, 8), "centre", "scale")


@query("WITH q AS (SELECT quantile_cont(a, [.25, .5, .75]) AS s, quantile_cont(b, [.25, .5, .75]) AS t FROM (SELECT c_custkey % 100 / 100 AS a, c_acctbal / 10000 AS b FROM customer)) SELECT c_custkey, round(least(greatest((c_custkey % 100 / 100 - s[2]) * (t[3] - t[1]) / (s[3] - s[1]) + t[2], 0), 1), 6) AS aligned FROM customer, q")
def iqr_alignment(t: Testbed) -> DataFrame:
    rows = t.table("customer").select("c_custkey", (F.col("c_custkey") % 100 / 100).alias("a"), (F.col("c_acctbal") / 10000).alias("b"))
    return rounded(atypical.aligned(rows, "a", "b").select("c_custkey", "aligned"), "aligned")


def _communities(t: Testbed) -> DataFrame:
    return t.table("orders").select(F.when(F.col("o_custkey") % 11 == 0, -1).otherwise(F.col("o_custkey") % 50).alias("community"), (F.col("o_totalprice") % 10 < 2).alias("is_aberrant"))


COMM = "r AS (SELECT CASE WHEN o_custkey % 11 = 0 THEN -1 ELSE o_custkey % 50 END AS community, o_totalprice % 10 < 2 AS a FROM orders), w AS (SELECT count(*) AS n, count(*) FILTER (a) AS m FROM r), c AS (SELECT community, count(*) AS d, count(*) FILTER (a) AS k FROM r GROUP BY 1)"


@query(f"WITH {COMM}, x AS (SELECT community, n, m, d, k, unnest(range(greatest(k, d + m - n), least(m, d) + 1)) AS x FROM c, w WHERE community >= 0 AND d >= 20), p AS (SELECT community, least(1, sum({_HYPER.format(m='m', n='n', d='d')})) AS p FROM x GROUP BY 1), q AS (SELECT community, p, least(1, min(p * mm / r) OVER (ORDER BY p DESC)) AS q FROM (SELECT *, count(*) OVER () AS mm, count(*) OVER (ORDER BY p) AS r FROM p)) SELECT c.community, d AS n, k, round(k / d, 6) AS fraction, round(p, 6) AS p, round(q, 6) AS q, coalesce(q < .05 AND k / d >= least(m / w.n + .1, 1.5 * m / w.n), false) AS suspicious FROM c LEFT JOIN q USING (community), w")
def enrichment_gate(t: Testbed) -> DataFrame:
    return rounded(atypical.suspicious_communities(_communities(t)).select("community", "n", "k", "fraction", "p", "q", "suspicious"), "fraction", "p", "q")


@query("WITH r AS (SELECT o_orderpriority AS label, o_totalprice % 10 < 2 AS a FROM orders), w AS (SELECT count(*) AS n, count(*) FILTER (a) AS m FROM r), c AS (SELECT label, count(*) AS d, count(*) FILTER (a) AS k FROM r GROUP BY 1), " + f"x AS (SELECT label, d, k, m, n, unnest(range(greatest(0, d + m - n), k + 1)) AS x FROM c, w), p AS (SELECT label, any_value(d) AS n, any_value(k) AS k, least(1, sum({_HYPER.format(m='m', n='n', d='d')})) AS p FROM x GROUP BY 1), q AS (SELECT *, least(1, min(p * mm / r) OVER (ORDER BY p DESC)) AS q FROM (SELECT *, count(*) OVER () AS mm, count(*) OVER (ORDER BY p) AS r FROM p)) SELECT label, n, k, round(p, 6) AS p, round(q, 6) AS q, q < .05 AS protected FROM q")
def protected_classes(t: Testbed) -> DataFrame:
    rows = t.table("orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") % 10 < 2).alias("is_aberrant"))
    return rounded(atypical.protected_classes(rows), "p", "q")


@query()
def mixture_seeds(t: Testbed) -> DataFrame:
    return rounded(atypical.mixture_seeds(atypical.abnormality(_features(t))).select("id", "abnormality", "is_seed"), "abnormality")


# --- trajectories ---------------------------------------------------------------------------------

POS = f"""{ROWS}, {PROTOS}, pr AS (SELECT id, z, label AS source, 'L' || ((substr(label, 2)::INT + 1 + id % 2) % 10) AS target FROM rows), e AS (SELECT 'L' || k AS source, 'L' || (k + 1) AS target FROM range(9) AS r(k)),
g AS (SELECT pr.id, pr.source, e.target, list_cosine_similarity(z, b.v) - list_cosine_similarity(z, a.v) AS gap, sqrt(2 * (1 - list_cosine_similarity(a.v, b.v))) AS most FROM pr LEFT JOIN e ON e.source = pr.source AND e.target = pr.target JOIN protos a ON a.label = pr.source JOIN protos b ON b.label = pr.target),
sp AS (SELECT source, target, quantile_cont(abs(gap), .99) AS span FROM g WHERE target IS NOT NULL GROUP BY 1, 2),
pos AS (SELECT id, g.source, g.target, CASE WHEN g.target IS NULL THEN 0 ELSE least(greatest((gap / most + 1) / 2, 0), 1) END AS absolute, CASE WHEN g.target IS NULL THEN 0 ELSE least(greatest((gap / span + 1) / 2, 0), 1) END AS relative FROM g LEFT JOIN sp ON sp.source = g.source AND sp.target = g.target)"""


def _positions(t: Testbed) -> DataFrame:
    at = F.substring("label", 2, 2).cast("int")
    rows = t.rows.select("id", "z", F.col("label").alias("source"), F.concat(F.lit("L"), (at + 1 + F.col("id") % 2) % 10).alias("target"))
    edges = t.spark.range(9).select(F.concat(F.lit("L"), "id").alias("source"), F.concat(F.lit("L"), F.col("id") + 1).alias("target"))
    return trajectory.edge_positions(rows, edges, classify.prototypes(t.rows))


@query(f"WITH {POS} SELECT id, source, target, round(absolute, 6) AS absolute, round(relative, 6) AS relative FROM pos")
def edge_position(t: Testbed) -> DataFrame:
    return rounded(_positions(t), "absolute", "relative")


@query(f"WITH {POS}, s AS (SELECT id, target IS NOT NULL AND relative > .1 AND relative < .8 AS m, relative, source, target, source AS predicted FROM pos) SELECT id, CASE WHEN m THEN 'Transitioning' ELSE 'Stable' END AS state, round(CASE WHEN m THEN (relative - .1) / .7 ELSE 0 END, 6) AS transition, CASE WHEN target IS NULL THEN '' WHEN relative >= .8 AND predicted = source THEN 'wrong_end' ELSE '' END AS conflict FROM s")
def trajectory_state(t: Testbed) -> DataFrame:
    out = trajectory.states(_positions(t).withColumn("predicted", F.col("source")), 0.1, 0.2)
    return rounded(out.select("id", "state", "transition", "conflict"), "transition")


@query(f"WITH {POS} SELECT id, round(a + absolute * (b - a), 6) AS place FROM (SELECT id, absolute, sqrt(substr(source, 2)::INT) AS a, coalesce(sqrt(substr(target, 2)::INT), sqrt(substr(source, 2)::INT)) AS b FROM pos)")
def composed_positions(t: Testbed) -> DataFrame:
    places = t.spark.range(10).select(F.concat(F.lit("L"), "id").alias("term"), F.sqrt("id").alias("place"))
    return rounded(trajectory.composed(_positions(t), places).select("id", "place"), "place")


@query(f"WITH {POS}, d AS (SELECT id, (id * 37) % 101 AS genes FROM rows), x AS (SELECT source AS term, genes FROM pos JOIN d USING (id) UNION ALL SELECT target, genes FROM pos JOIN d USING (id) WHERE target IS NOT NULL) SELECT term, round(-avg(genes), 6) AS score FROM x GROUP BY 1")
def detection_score(t: Testbed) -> DataFrame:
    return rounded(trajectory.detection_scores(_positions(t), t.rows.select("id", (F.col("id") * 37 % 101).alias("genes"))), "score")


@query(f"WITH RECURSIVE {UP}, f AS (SELECT u.node, ancestor, row_number() OVER (PARTITION BY u.node ORDER BY shortest, ancestor) AS r FROM up u WHERE ancestor IN ('A', 'B', 'D')) SELECT n.node AS term, coalesce(ancestor, n.node) AS lineage, ancestor IS NOT NULL AS has_fate FROM nodes n LEFT JOIN f ON f.node = n.node AND r = 1")
def lineage_assignment(t: Testbed) -> DataFrame:
    return trajectory.lineages(ontology.closure(t.edges), t.spark.createDataFrame([("A",), ("B",), ("D",)], "node string"), ontology.nodes(t.edges))


@query("WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d FROM customer) SELECT least(floor((c_acctbal - a) / (b - a) * 16), 15)::BIGINT AS bx, least(floor((c_nationkey - c) / (d - c) * 16), 15)::BIGINT AS by, count(*) AS n FROM customer, e GROUP BY 1, 2")
def label_density_grid(t: Testbed) -> DataFrame:
    return trajectory.density_grid(t.table("customer"), "c_acctbal", "c_nationkey", 16)


@query(f"WITH {EVENTS}, w AS (SELECT *, value - avg(value) OVER (PARTITION BY lineage, gene) AS d FROM ev), r AS (SELECT *, sum(d) OVER (PARTITION BY lineage, gene ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS run FROM w) SELECT lineage, gene, count(*) AS n, round((greatest(max(run), 0) - least(min(run), 0)) / (stddev_pop(value) * sqrt(count(*))), 6) AS statistic FROM r GROUP BY 1, 2")
def walk_statistic(t: Testbed) -> DataFrame:
    return rounded(trends.walk_statistics(t.events), "statistic")


@query(f"WITH {EVENTS} SELECT lineage, id, round(value - avg(value) OVER w - regr_slope(value, covariate) OVER w * (covariate - avg(covariate) OVER w), 5) + 0.0 AS residual FROM ev WINDOW w AS (PARTITION BY lineage, gene)")
def trend_residuals(t: Testbed) -> DataFrame:
    return rounded(trends.residuals(t.events).select("lineage", "id", "residual"), "residual", digits=5)


@query(f"WITH {EVENTS}, s AS (SELECT lineage, type, ((row_number() OVER (PARTITION BY lineage ORDER BY rank, id) - 1) * 60) // count(*) OVER (PARTITION BY lineage) AS slice FROM ev), c AS (SELECT lineage, slice, type, count(*) AS n, row_number() OVER (PARTITION BY lineage, slice ORDER BY count(*) DESC, type) AS r FROM s GROUP BY 1, 2, 3) SELECT lineage, slice, type, n FROM c WHERE r = 1")
def slice_modes(t: Testbed) -> DataFrame:
    return trajectory.slice_modes(t.events.select("lineage", "id", "rank", "type"))


@query(f"WITH {EVENTS}, o AS (SELECT lineage, gene, count(*) AS detected, round(avg(value), 4) AS statistic FROM ev GROUP BY 1, 2), b AS (SELECT *, ((row_number() OVER (PARTITION BY lineage ORDER BY detected, gene) - 1) * 5) // count(*) OVER (PARTITION BY lineage) AS stratum FROM o), p AS (SELECT ev.lineage, stratum, round(value, 1) AS v FROM ev JOIN b USING (lineage, gene)) SELECT b.lineage, b.gene::VARCHAR AS gene, b.statistic, b.stratum, round((count(*) FILTER (v >= b.statistic) + 1) / (count(*) + 1), 6) AS p FROM b JOIN p ON p.lineage = b.lineage AND p.stratum = b.stratum GROUP BY 1, 2, 3, 4")
def stratified_p(t: Testbed) -> DataFrame:
    observed = t.events.groupBy("lineage", "gene").agg(F.count("*").alias("detected"), F.round(F.avg("value"), 4).alias("statistic"))
    return rounded(trends.stratified_p(observed, t.events.select("lineage", "gene", F.round("value", 1).alias("statistic"))), "p")


@query()
def trend_curves(t: Testbed) -> DataFrame:
    ranked = stats.pct_rank(t.events, "rank", ["lineage"], "pct")
    return trends.curves(ranked.select("lineage", "id", F.col("pct").alias("rank"), "gene", "value")).select("lineage", "gene", "level", "peak")


@query()
def shuffled_walks(t: Testbed) -> DataFrame:
    return rounded(trends.shuffled_statistics(t.events), "statistic")


# --- doublets, simplification, whole analyses -------------------------------------------------------

BLEND = "b AS (SELECT c_custkey, c_nationkey AS batch, c_custkey % 17 AS pann, c_custkey % 23 AS dr, c_custkey % 5 AS cxds FROM customer), " + "r AS (SELECT *, count(*) OVER () AS n, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in ("pann", "dr", "cxds")) + " FROM b), s AS (SELECT c_custkey, batch, round((.4 * r_pann + .4 * r_dr + .2 * r_cxds) / n, 9) AS score FROM r)"


def _blended(t: Testbed) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.table("customer").select("c_custkey", F.col("c_nationkey").alias("batch"), (k % 17).alias("pann"), (k % 23).alias("dr"), (k % 5).alias("cxds"))
    return rounded(doublets.blended(rows).select("c_custkey", "batch", "score"), "score", digits=9)


@query(f"WITH {BLEND} SELECT c_custkey, batch, score FROM s")
def doublet_rank_blend(t: Testbed) -> DataFrame:
    return _blended(t)


@query(f"WITH {BLEND}, q AS (SELECT batch, count(*) AS n, quantile_cont(score, .92) AS c FROM s GROUP BY 1) SELECT c_custkey, CASE WHEN n < 5 THEN 0 ELSE score END AS score, n >= 5 AND score >= c - 1e-12 AS is_doublet FROM s JOIN q USING (batch)")
def doublet_calls(t: Testbed) -> DataFrame:
    return doublets.called(_blended(t), by=["batch"], least=5).select("c_custkey", "score", "is_doublet")


@query()
def doublet_neighbourhoods(t: Testbed) -> DataFrame:
    return rounded(doublets.neighbourhoods(t.rows.select("id", "z")), "pann")


@query()
def doublet_co_expression(t: Testbed) -> DataFrame:
    return rounded(doublets.co_expression(t.coarse, t.cells), "cxds")


@query()
def similarity_simplification(t: Testbed) -> DataFrame:
    return simplify.by_similarity(t.edges, t.counts, 0.6)


@query()
def prediction_with_refinement(t: Testbed) -> DataFrame:
    return rounded(compose.predict(t.rows, classify.prototypes(t.rows), compose.Settings(neighbours=10)), "score")


@query()
def evaluation(t: Testbed) -> DataFrame:
    out = compose.evaluate(t.rows, classify.prototypes(t.rows), t.edges, compose.Settings(neighbours=10))
    return out.select("id", "label", "abnormality", "is_seed", "community", "is_atypical")


@query()
def pseudotime(t: Testbed) -> DataFrame:
    fates = t.spark.createDataFrame([("A",), ("B",), ("D",)], "node string")
    return rounded(compose.pseudotime(_positions(t), t.edges, t.rows.select("id", (F.col("id") * 37 % 101).alias("genes")), fates), "place", "pct")


@query(f"WITH {POS}, s AS (SELECT id % 3 AS grp, source, target, CASE WHEN target IS NOT NULL AND relative > .1 AND relative < .9 THEN 'Transitioning' ELSE 'Stable' END AS state FROM pos) SELECT grp AS \"group\", source, target, state, count(*) AS n, round(count(*) / any_value(size), 6) AS share FROM s JOIN (SELECT id % 3 AS grp, count(*) AS size FROM rows GROUP BY 1) USING (grp) GROUP BY 1, 2, 3, 4")
def group_comparison(t: Testbed) -> DataFrame:
    return rounded(compose.compare(_positions(t), t.rows.select("id", (F.col("id") % 3).alias("group"))), "share")
