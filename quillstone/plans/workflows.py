"""Further queries over the driver's tables: preparation, vocabulary, placement, trends along an order, markers and whole predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import atypical, classify, expression, graph, labels, ontology, preparation, stats, trajectory, trends
from quillstone.plans import compose
from quillstone.plans.catalog import ADH, POS, TOP, _positions, _sims, query, rounded
from quillstone.plans.testbed import EDGES_SQL, EVENTS, EXPR, KNN, PROTOS, ROWS, SIMS, UP, Testbed

# --- preparation ----------------------------------------------------------------------------------

MITO = "[" + ", ".join(f"'{g}'" for g in preparation.HUMAN_MITO) + "]"
NAMED = f"named AS (SELECT cell, CASE WHEN gene < 13 THEN ({MITO})[gene + 1] ELSE 'ENSG' || lpad(gene::VARCHAR, 11, '0') END AS gene, value FROM expr)"


def _named(t: Testbed) -> DataFrame:
    """Measurements under gene ids, some with a version; the first thirteen parts are mitochondrial."""
    mito = F.element_at(F.array(*[F.lit(g) for g in preparation.HUMAN_MITO]), (F.least("gene", F.lit(12)) + 1).cast("int"))
    plain = F.when(F.col("gene") < 13, mito).otherwise(F.concat(F.lit("ENSG"), F.lpad(F.col("gene").cast("string"), 11, "0")))
    return t.expr.withColumn("gene", F.when(F.col("gene") % 2 == 0, F.concat(plain, F.lit(".7"))).otherwise(plain))


@query(f"WITH {EXPR}, {NAMED}, s AS (SELECT cell, sum(value) AS total, count(*) FILTER (value != 0) AS genes, sum(CASE WHEN gene IN (SELECT unnest({MITO})) THEN value ELSE 0 END) AS marked FROM named GROUP BY 1) SELECT cell, total, genes, round(100 * marked / total, 6) AS marked_pct FROM s WHERE total >= 50 AND genes >= 2 AND 100 * marked / total <= 20")
def cell_filter(t: Testbed) -> DataFrame:
    return rounded(preparation.filter_cells(_named(t), t.cells, 50, 2, 20.0), "marked_pct")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand ELSE '.' || p_brand END AS gene FROM part")
def stripped_versions(t: Testbed) -> DataFrame:
    k = F.col("p_partkey") % 3
    gene = F.when(k == 0, F.concat("p_brand", F.lit(".12"))).when(k == 1, F.col("p_brand")).otherwise(F.concat(F.lit("."), "p_brand"))
    return t.table("part").select("p_partkey", preparation.strip_version(gene).alias("gene"))


def _mapping(t: Testbed) -> DataFrame:
    part = t.table("part")
    symbol = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    human = part.select(F.lit("human").alias("species"), symbol.alias("symbol"), F.col("p_partkey").cast("string").alias("gene"))
    return human.unionByName(part.where("p_size < 10").select(F.lit("mouse").alias("species"), symbol.alias("symbol"), F.concat(F.lit("m"), "p_partkey").alias("gene")))


@query("WITH m AS (SELECT p_brand || '-' || p_size AS symbol, count(*) AS hits FROM part GROUP BY 1), w AS (SELECT DISTINCT p_brand || '-' || (p_size + 5) AS symbol FROM part) SELECT 'human' AS species, count(*) AS n_input, count(*) FILTER (hits = 1) AS n_mapped, count(*) FILTER (hits > 1) AS n_ambiguous, count(*) FILTER (hits IS NULL) AS n_unmapped FROM w LEFT JOIN m USING (symbol)")
def gene_mapping_report(t: Testbed) -> DataFrame:
    wanted = t.table("part").select(F.concat_ws("-", "p_brand", (F.col("p_size") + 5).cast("string")).alias("symbol")).distinct()
    return preparation.mapping_report(preparation.map_genes(wanted, _mapping(t)))


@query("SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos FROM part WHERE p_size <= 25")
def model_gene_order(t: Testbed) -> DataFrame:
    return preparation.model_order(t.table("part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("model_order")))


@query("SELECT 'raw' AS slot, 'raw_counts' AS kind, count(*) AS n, sum(l_quantity) AS total FROM lineitem")
def expression_slot(t: Testbed) -> DataFrame:
    lines = t.table("lineitem")
    slots = [("counts", lines.select(F.col("l_extendedprice").alias("value"))), ("raw", lines.select(F.col("l_quantity").alias("value"))), ("X", lines.select(F.log1p("l_quantity").alias("value")))]
    name, chosen, kind = preparation.expression_source(slots)
    return chosen.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(name).alias("slot"), F.lit(kind).alias("kind"), "n", "total")


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, .9) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice > 50000 AS is_low_quality FROM lineitem")
def low_quality_mask(t: Testbed) -> DataFrame:
    return expression.low_quality(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 50000.0).select("l_orderkey", "l_linenumber", "is_low_quality")


@query("SELECT c_custkey, n AS o_n, top AS o_top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def attached_results(t: Testbed) -> DataFrame:
    """The results have their keys, with blanks around them, in a column of another name."""
    made = t.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    results = made.select(F.format_string("  %d ", F.col("o_custkey")).alias("who"), F.col("n").cast("double").alias("n"), "top")
    return labels.attach(t.table("customer").select("c_custkey"), results, "c_custkey", "id", "o_").select("c_custkey", F.col("o_n").cast("long").alias("o_n"), "o_top")


@query()
def doublets_from_counts(t: Testbed) -> DataFrame:
    return rounded(preparation.detect_doublets(t.coarse, t.cells).select("cell", "doublet_score", "is_doublet"), "doublet_score")


@query()
def principal_components(t: Testbed) -> DataFrame:
    """Sizes of the components; their signs are free."""
    found = compose.reduced_dimensions(t.rows.select("id", "z"), 5)
    return rounded(found.select(F.posexplode("z").alias("component", "x")).groupBy("component").agg(F.var_samp("x").alias("variance")), "variance", digits=5)


@query()
def approximate_knn(t: Testbed) -> DataFrame:
    return rounded(graph.approximate(t.rows, t.rows, 10), "sim")


# --- vocabulary -----------------------------------------------------------------------------------

KEPT = "kept AS (SELECT node FROM nodes WHERE node IN ('A', 'C', 'D', 'R', 'L0', 'L4', 'L7'))"


def _kept(t: Testbed) -> DataFrame:
    return ontology.nodes(t.edges).where("node in ('A', 'C', 'D', 'R', 'L0', 'L4', 'L7')")


@query(f"WITH RECURSIVE {UP} SELECT e.child, e.parent FROM edges e JOIN up ON up.node = e.child AND up.ancestor = e.parent WHERE longest = 1")
def reduced_vocabulary(t: Testbed) -> DataFrame:
    return ontology.reduced(t.edges)


@query(f"WITH RECURSIVE {UP}, {KEPT}, p AS (SELECT u.node AS child, u.ancestor AS parent FROM up u WHERE shortest > 0 AND u.node IN (SELECT node FROM kept) AND ancestor IN (SELECT node FROM kept)) SELECT child, parent FROM p WHERE NOT EXISTS (SELECT 1 FROM p a JOIN p b ON a.parent = b.child WHERE a.child = p.child AND b.parent = p.parent)")
def small_tree(t: Testbed) -> DataFrame:
    return ontology.small_tree(t.edges, _kept(t))


@query(f"WITH RECURSIVE {UP}, {KEPT}, f AS (SELECT up.node, ancestor, row_number() OVER (PARTITION BY up.node ORDER BY up.shortest, d.longest DESC, ancestor) AS r FROM up JOIN depth d ON d.node = ancestor WHERE ancestor IN (SELECT node FROM kept)) SELECT node, ancestor AS target FROM f WHERE r = 1")
def walked_up(t: Testbed) -> DataFrame:
    return ontology.walked_up(t.edges, _kept(t))


@query(f"WITH RECURSIVE {UP}, s AS (SELECT ancestor AS node, count(*) AS n FROM up GROUP BY 1) SELECT s.node, row_number() OVER (ORDER BY n DESC, shortest, s.node) - 1 AS place FROM s JOIN depth USING (node)")
def canonical_order(t: Testbed) -> DataFrame:
    return ontology.canonical_order(t.edges)


GROUPS = "grp AS (SELECT DISTINCT c_nationkey % 5 AS \"group\", 'L' || (c_custkey % (2 + c_nationkey % 5)) AS label FROM customer)"


def _groups(t: Testbed) -> DataFrame:
    g = F.col("c_nationkey") % 5
    return t.table("customer").select(g.alias("group"), F.concat(F.lit("L"), F.col("c_custkey") % (2 + g)).alias("label")).distinct()


COMMON = f"{UP}, {GROUPS}, k AS (SELECT \"group\", ancestor AS node, count(*) AS k FROM grp JOIN up ON up.node = label GROUP BY 1, 2), z AS (SELECT \"group\", count(*) AS n FROM grp GROUP BY 1), m AS (SELECT k.\"group\", k.node FROM k JOIN z ON z.\"group\" = k.\"group\" AND k = n), com AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m x JOIN up ON up.node = x.node AND up.shortest > 0 WHERE x.\"group\" = m.\"group\" AND up.ancestor = m.node))"


@query(f'WITH RECURSIVE {COMMON} SELECT "group", node FROM com')
def common_terms(t: Testbed) -> DataFrame:
    return ontology.common_terms(t.edges, _groups(t))


@query(f'WITH RECURSIVE {COMMON} SELECT z."group", coalesce(bool_and(node IN (SELECT node FROM roots)), true) AS is_multi FROM z LEFT JOIN com ON com."group" = z."group" GROUP BY 1')
def multi_lineage(t: Testbed) -> DataFrame:
    return ontology.multi_lineage(t.edges, _groups(t))


@query()
def relevant_nodes(t: Testbed) -> DataFrame:
    return ontology.relevant(t.edges, t.counts)


@query()
def pruned_vocabulary(t: Testbed) -> DataFrame:
    least = t.counts.agg(F.percentile("n", F.lit(0.5))).first()[0]
    return ontology.pruned(t.edges, t.counts, int(least))


# --- placement --------------------------------------------------------------------------------------

NAMES = ["early stem cell", "lymphoblast", "mature cell", "primary neuron (sensu teleostei)", "terminally differentiated cell", "pluripotent progenitor", "blastocyst", None, "fetal pre-B cell"]
EARLY = """CASE WHEN lower(n) IN ('pre-venule capillary cell', 'primary motor cortex pyramidal cell', 'primary neuron (sensu teleostei)', 'primary sensory neuron (sensu teleostei)') THEN 0 ELSE
regexp_matches(n, '^(?i)(immature |early |pre-|primitive |embryonic |fetal |neonatal |primary )')::INT + regexp_matches(n, '(?i)pluripotent')::INT + regexp_matches(n, '(?i)progenitor')::INT + regexp_matches(n, '(?i)precursor')::INT
+ regexp_matches(n, '(?i)poietic')::INT + regexp_matches(n, '(?i)\\bstem cell\\b')::INT + regexp_matches(n, '(?i)blast\\b')::INT END"""
NAME_TABLE = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if n is None else repr(n)})" for k, n in enumerate(NAMES)) + ") AS v(k, name)), cnt AS (SELECT k, name, (" + EARLY + ") AS early, regexp_matches(n, '(?i)terminally differentiated')::INT AS final FROM (SELECT k, name, coalesce(name, '') AS n FROM nm))"


def _names(t: Testbed) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(NAMES)), "k int, name string")


@query(f"WITH {NAME_TABLE} SELECT a.k AS a, b.k AS b, coalesce(CASE WHEN a.early != b.early THEN sign(a.early - b.early) WHEN a.final != b.final THEN sign(b.final - a.final) END, 0)::INT AS way FROM cnt a JOIN cnt b ON a.k < b.k")
def name_directions(t: Testbed) -> DataFrame:
    n = _names(t)
    pairs = n.select(F.col("k").alias("a"), F.col("name").alias("x")).join(n.select(F.col("k").alias("b"), F.col("name").alias("y")), F.col("a") < F.col("b"))  # nine names
    return pairs.select("a", "b", F.coalesce(trajectory.name_direction(F.col("x"), F.col("y")), F.lit(0)).alias("way"))


@query(
    f"WITH RECURSIVE {UP}, e AS (SELECT DISTINCT 'L' || (c_nationkey % 10) AS a, 'L' || (c_custkey % 10) AS b FROM customer UNION SELECT child, parent FROM edges), g AS (SELECT a, b, ascii(a[-1]) * 10 + ascii(b[-1]) AS w FROM e WHERE a != b),"
    + " p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM g), r AS (SELECT p.*, da.shortest AS x, db.shortest AS y FROM p JOIN depth da ON da.node = a JOIN depth db ON db.node = b),"
    + " way AS (SELECT a AS source, b AS target, CASE WHEN x != y THEN 'depth' ELSE 'none' END AS rule FROM r WHERE x <= y UNION ALL SELECT b, a, CASE WHEN x != y THEN 'depth' ELSE 'none' END FROM r WHERE x >= y)"
    + " SELECT source, target, coalesce(w.w, v.w) AS weight, rule FROM way LEFT JOIN g w ON w.a = source AND w.b = target LEFT JOIN g v ON v.a = target AND v.b = source WHERE rule != 'none' OR w.w IS NOT NULL"
)
def directed_pairs(t: Testbed) -> DataFrame:
    e = t.table("customer").select(F.concat(F.lit("L"), F.col("c_nationkey") % 10).alias("a"), F.concat(F.lit("L"), F.col("c_custkey") % 10).alias("b")).union(t.edges.select("child", "parent")).distinct().where("a != b")
    pairs = e.withColumn("weight", F.ascii(F.right("a", F.lit(1))) * 10 + F.ascii(F.right("b", F.lit(1))))
    return trajectory.directed(pairs, ontology.depths(t.edges), t.spark.createDataFrame([], "node string, name string"))


@query(f"WITH {ROWS}, {PROTOS} SELECT p.label, round(min(list_distance(p.v, r.v)), 6) AS distance FROM protos p JOIN protos r ON r.label IN ('L0', 'L5') GROUP BY 1")
def root_distance(t: Testbed) -> DataFrame:
    roots = t.spark.createDataFrame([("L0",), ("L5",)], "node string")
    return rounded(trajectory.root_distances(classify.prototypes(t.rows), roots), "distance")


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN .5 ELSE (o_orderkey % 997) / 997 END AS x FROM orders), b AS (SELECT *, least(greatest(floor(x / .005), 0), 199)::INT AS bin FROM r), h AS (SELECT bin FROM b GROUP BY 1 HAVING count(*) > .05 * (SELECT count(*) FROM b)) SELECT o_orderkey, bin IN (SELECT bin + d FROM h, (VALUES (-1), (0), (1)) AS v(d)) AS in_spike FROM b")
def spike_rows(t: Testbed) -> DataFrame:
    x = F.when(F.col("o_custkey") % 4 == 0, 0.5).otherwise((F.col("o_orderkey") % 997) / 997)
    return trajectory.spike_bins(t.table("orders").select("o_orderkey", x.alias("relative"))).select("o_orderkey", "in_spike")


@query()
def edge_spread(t: Testbed) -> DataFrame:
    at = F.substring("label", 2, 2).cast("int")
    rows = t.rows.select("id", "z", F.col("label").alias("predicted"), (F.col("id") % 5 == 0).alias("on_inferred"), (F.col("id") % 5 == 0).alias("moving"), F.col("label").alias("source"), F.concat(F.lit("L"), (at + 1) % 10).alias("target"))
    edges = t.spark.range(10).select(F.concat(F.lit("L"), "id").alias("a"), F.concat(F.lit("L"), (F.col("id") + 1) % 10).alias("b"))
    return trajectory.spread_verdicts(rows, edges, least=5)


WEIGHTS = ADH + f", {EDGES_SQL}, sib AS (SELECT DISTINCT x.child AS child, y.child AS parent FROM edges x JOIN edges y ON x.parent = y.parent AND x.child < y.child)"


@query(WEIGHTS + ", s AS (SELECT a.id, a.weight + b.weight AS w FROM w a JOIN sib ON sib.child = a.label JOIN w b ON b.id = a.id AND b.label = sib.parent), n AS (SELECT id, max(weight) AS n FROM w GROUP BY 1) SELECT id, round(greatest(n, coalesce(max(w), 0)), 6) AS adherence FROM n LEFT JOIN s USING (id) GROUP BY id, n")
def edge_adherence(t: Testbed) -> DataFrame:
    pair = lambda c: t.edges.select(F.col("child").alias(c), "parent")
    siblings = pair("x").join(pair("y"), "parent").where("x < y").select(F.col("x").alias("child"), F.col("y").alias("parent")).distinct()
    return rounded(atypical.edge_adherence(atypical.adherence(_sims(t), 5).select("id", "label", "weight"), siblings).select("id", "adherence"), "adherence")


@query("WITH r AS (SELECT c_custkey AS id, c_mktsegment AS label, c_acctbal / 10000 AS value FROM customer), f AS (SELECT label, median(value) AS c, 1.4826 * quantile_cont(abs(value), .5) AS s FROM r GROUP BY 1 HAVING label != 'BUILDING') SELECT id, round(CASE WHEN s IS NULL THEN least(greatest(value, 0), 1) ELSE least(greatest(.5 * value + .5 / (1 + exp(-least(greatest((value - c) / s, -60), 60))), 0), 1) END, 6) AS blended FROM r LEFT JOIN f USING (label)")
def blended_adherence(t: Testbed) -> DataFrame:
    rows = t.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") / 10000).alias("value"))
    references = rows.groupBy("label").agg(F.percentile("value", F.lit(0.5)).alias("centre"), (1.4826 * F.percentile(F.abs("value"), F.lit(0.5))).alias("scale")).withColumn("valid", F.col("label") != "BUILDING")
    return rounded(atypical.relative_adherence(rows, references).select("id", "blended"), "blended")


@query(
    f"WITH RECURSIVE {UP}, {POS.replace(', e AS', ', e2 AS').replace('LEFT JOIN e ON e.source = pr.source AND e.target = pr.target', 'LEFT JOIN e2 e ON e.source = pr.source AND e.target = pr.target')},"
    + " tg AS (SELECT node, CASE WHEN node IN ('L0', 'L1') THEN 'A' WHEN node IN ('L2', 'L3') THEN 'B' WHEN node IN ('L5', 'L6', 'L7') THEN 'D' ELSE node END AS target FROM nodes),"
    + " j AS (SELECT p.id, s.target AS ss, g.target AS st, ds.shortest AS sd, dg.shortest AS td, dss.shortest AS ssd, dst.shortest AS std, relative FROM pos p LEFT JOIN tg s ON s.node = p.source LEFT JOIN tg g ON g.node = p.target"
    + " LEFT JOIN depth ds ON ds.node = p.source LEFT JOIN depth dg ON dg.node = p.target LEFT JOIN depth dss ON dss.node = s.target LEFT JOIN depth dst ON dst.node = g.target)"
    + " SELECT id, ss AS small_source, CASE WHEN ss || st IN ('AB', 'BL4', 'DL8') THEN st END AS small_target, round(CASE WHEN ss || st IN ('AB', 'BL4', 'DL8') AND std != ssd THEN least(greatest((sd + relative * (td - sd) - ssd) / (std - ssd), 0), 1) ELSE 0 END, 6) AS small_relative FROM j"
)
def projected_positions(t: Testbed) -> DataFrame:
    kept = ontology.nodes(t.edges).withColumn("target", F.expr("case when node in ('L0', 'L1') then 'A' when node in ('L2', 'L3') then 'B' when node in ('L5', 'L6', 'L7') then 'D' else node end"))
    small = t.spark.createDataFrame([("A", "B"), ("B", "L4"), ("D", "L8")], "source string, target string")
    return rounded(trajectory.projected(_positions(t), kept, ontology.depths(t.edges), small), "small_relative")


ARROWS = f"WITH {ROWS}, {KNN}, pl AS (SELECT id, label AS lineage, id % 101 AS rank, z[1] AS x, z[2] AS y FROM rows), pr AS (SELECT src, b.rank - a.rank AS g, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) AS l FROM knn JOIN pl a ON a.id = src JOIN pl b ON b.id = dst WHERE a.lineage = b.lineage), md AS (SELECT median(abs(g)) AS m FROM pr WHERE g != 0)"


@query(ARROWS + ", w AS (SELECT *, (1 - 2 / (exp(2 * g / m) + 1)) / greatest(l, 1e-12) AS w FROM pr, md) SELECT src AS id, round(avg(dx * w), 6) + 0.0 AS dx, round(avg(dy * w), 6) + 0.0 AS dy FROM w GROUP BY 1")
def neighbour_arrows(t: Testbed) -> DataFrame:
    placed = t.rows.select("id", F.col("label").alias("lineage"), (F.col("id") % 101).alias("rank"), F.col("z")[0].alias("x"), F.col("z")[1].alias("y"))
    return rounded(graph.arrows(placed, graph.nearest(t.rows, t.rows, 10)), "dx", "dy")


# --- trends -----------------------------------------------------------------------------------------

WALK_CELLS = f"{EVENTS}, cl AS (SELECT lineage, id, row_number() OVER (PARTITION BY lineage ORDER BY rank, id) AS place, covariate FROM ev), gn AS (SELECT lineage, gene FROM ev WHERE value > 0 GROUP BY 1, 2), dn AS (SELECT cl.lineage, gn.gene, place, cl.covariate, CASE WHEN ev.value > 0 THEN value ELSE 0 END AS value FROM cl JOIN gn USING (lineage) LEFT JOIN ev ON ev.lineage = cl.lineage AND ev.id = cl.id AND ev.gene = gn.gene)"
WALK = ", run AS (SELECT *, sum({r}) OVER (PARTITION BY lineage, gene ORDER BY place) AS run FROM {src}) SELECT lineage, gene, count(*) AS n, round((greatest(max(run), 0) - least(min(run), 0)) / (stddev_pop({r}) * sqrt(count(*))), 5) AS statistic FROM run GROUP BY 1, 2"


def _entries(t: Testbed) -> tuple[DataFrame, DataFrame]:
    return t.events.where("value > 0").select("lineage", "id", "gene", "value"), trends.places(t.events.select("lineage", "id", "rank", "covariate"), "rank", "id")


@query(f"WITH {WALK_CELLS}, d AS (SELECT *, value - avg(value) OVER (PARTITION BY lineage, gene) AS r FROM dn)" + WALK.format(r="r", src="d"))
def sparse_walks(t: Testbed) -> DataFrame:
    entries, cells = _entries(t)
    return rounded(trends.sparse_walks(entries, cells.drop("covariate")), "statistic", digits=5)


@query(f"WITH {WALK_CELLS}, d AS (SELECT *, value - avg(value) OVER w - regr_slope(value, covariate) OVER w * (covariate - avg(covariate) OVER w) AS r FROM dn WINDOW w AS (PARTITION BY lineage, gene))" + WALK.format(r="r", src="d"))
def sparse_walks_adjusted(t: Testbed) -> DataFrame:
    entries, cells = _entries(t)
    return rounded(trends.sparse_walks(entries, cells), "statistic", digits=5)


@query("WITH d AS (SELECT p_brand AS lineage, p_partkey AS gene, (p_partkey * 31) % 100 / 100 AS detection FROM part), q AS (SELECT lineage, quantile_cont(detection, [.2, .4, .6, .8]) AS e FROM d GROUP BY 1) SELECT d.lineage, gene, len(list_filter(e, lambda x: x < detection)) AS stratum FROM d JOIN q USING (lineage)")
def detection_strata(t: Testbed) -> DataFrame:
    rows = t.table("part").select(F.col("p_brand").alias("lineage"), F.col("p_partkey").alias("gene"), ((F.col("p_partkey") * 31) % 100 / 100).alias("detection"))
    return trends.detection_strata(rows).select("lineage", "gene", "stratum")


@query(f"WITH {EVENTS}, o AS (SELECT lineage, gene, round(avg(value), 4) AS statistic, gene % 3 AS stratum FROM ev GROUP BY 1, 2), s AS (SELECT lineage, gene % 3 AS stratum, round(value, 1) AS v FROM ev) SELECT o.lineage, gene, statistic, round((count(*) FILTER (v >= statistic) + 1) / (count(*) + 1), 6) AS p FROM o JOIN s ON s.lineage = o.lineage AND s.stratum = o.stratum GROUP BY 1, 2, 3")
def pooled_p(t: Testbed) -> DataFrame:
    observed = t.events.groupBy("lineage", "gene").agg(F.round(F.avg("value"), 4).alias("statistic")).withColumn("stratum", F.col("gene") % 3)
    return rounded(trends.pooled_p(observed, t.events.select("lineage", "gene", F.round("value", 1).alias("statistic"))).select("lineage", "gene", "statistic", "p"), "p")


@query()
def gene_trends(t: Testbed) -> DataFrame:
    """All customers of a segment in the order of their balance, their orders' parts as genes."""
    orders = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = orders.select(F.col("c_mktsegment").alias("lineage"), F.col("o_orderkey").alias("id"), F.col("c_acctbal").alias("rank"), (F.col("o_totalprice") / 1000).alias("covariate"), F.col("o_orderpriority").alias("type"))
    return rounded(trends.gene_trends(t.coarse.withColumnRenamed("cell", "id"), cells, keep_all=True), "strength", "p", "q", "peak", digits=5)


# --- markers, networks, predictions -----------------------------------------------------------------


@query()
def found_markers(t: Testbed) -> DataFrame:
    return rounded(stats.find_markers(t.coarse, t.sampled, 10), "mean", "spec", "contrast", "p", "reproducibility")


@query()
def gene_modules(t: Testbed) -> DataFrame:
    masses = t.coarse.groupBy("gene").agg(F.sum(F.abs("value")).alias("mass"))
    _, modules, _ = stats.gene_networks(t.coarse, t.coarse, t.cells.count(), masses, least=0.02)
    return rounded(modules, "mass")


HEADS = f"""WITH {ROWS}, {PROTOS}, {SIMS}, {EDGES_SQL}, hop AS (SELECT child AS label, parent AS near FROM edges UNION SELECT parent, child FROM edges UNION SELECT child, child FROM edges),
th AS (SELECT a.label, b.label AS seen, list_cosine_similarity(a.v, b.v) AS y FROM protos a JOIN protos b ON b.label != 'L9'),
pf AS (SELECT s.id, th.label, greatest(coalesce(corr(s.sim, th.y), 0), 0) AS profile FROM sims s JOIN th ON th.seen = s.label GROUP BY 1, 2),
s AS (SELECT id, label, CASE WHEN label != 'L9' THEN round(exp(sim) / 10, 9) ELSE 1e-10 END AS expert, least(greatest(sim, 0), 1) AS geometry, profile, label != 'L9' AS seen FROM sims JOIN pf USING (id, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(expert, 9) DESC, label) AS re, row_number() OVER (PARTITION BY id ORDER BY seen DESC, round(expert, 9) DESC, label) AS rs,
    row_number() OVER (PARTITION BY id ORDER BY round(geometry, 9) DESC, label) AS rg, row_number() OVER (PARTITION BY id ORDER BY round(profile, 9) DESC, label) AS rp FROM s),
c AS (SELECT *, least(greatest(coalesce(max(geometry) FILTER (rs = 1 AND seen) OVER w - max(geometry) FILTER (rs = 2 AND seen) OVER w, 0), 0), 1) AS c, max(geometry) OVER w AS top,
    max(label) FILTER (re = 1) OVER w AS be, max(label) FILTER (rg = 1) OVER w AS bg, max(label) FILTER (rp = 1) OVER w AS bp FROM r WINDOW w AS (PARTITION BY id)),
around AS (SELECT DISTINCT id, near AS label FROM c JOIN hop USING (label) WHERE re <= 3),
o AS (SELECT c.id, c.label, CASE WHEN geometry >= .85 * top OR rp <= 15 OR a.id IS NOT NULL THEN .8 * c * expert + (.1 * c + .6 * (1 - c)) * geometry + (.1 * c + .4 * (1 - c)) * profile ELSE 0 END AS score,
    CASE WHEN be = bg AND be = bp THEN 'gold' WHEN be = bg OR be = bp OR bg = bp THEN 'silver' ELSE 'bronze' END AS tier FROM c LEFT JOIN around a ON a.id = c.id AND a.label = c.label),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) AS rank FROM o)"""


def _consensus(t: Testbed, refine: bool) -> DataFrame:
    protos = classify.prototypes(t.rows)
    seen = protos.where("label != 'L9'").select("label")
    expert = _sims(t).where("label != 'L9'").select("id", "label", F.round(F.exp("sim") / 10, 9).alias("score"))
    return rounded(compose.predict_by_consensus(t.rows, protos, expert, t.edges, seen, compose.Settings(neighbours=10), refine), "score")


@query(HEADS + " SELECT id, label, round(score, 6) AS score, rank, tier FROM k WHERE rank <= 5")
def consensus_prediction(t: Testbed) -> DataFrame:
    return _consensus(t, False)


@query()
def consensus_prediction_refined(t: Testbed) -> DataFrame:
    return _consensus(t, True)


@query(TOP + """, best AS (SELECT id, label, greatest(sim, 0) AS s FROM ranked WHERE rank = 1), n AS (SELECT label, count(*) AS n FROM best GROUP BY 1), l AS (SELECT least(ceil(sum(n) * 1.0 / 100), 20) AS l FROM n)
    SELECT id, best.label AS x_prediction, round(s, 6) AS x_prediction_confidence, CASE WHEN n < l THEN 'Rare' ELSE best.label END AS x_prediction_bucket FROM best JOIN n USING (label), l""")
def written_predictions(t: Testbed) -> DataFrame:
    found = compose.predict(t.rows, classify.prototypes(t.rows), refine=False)
    return rounded(compose.write_predictions(t.rows.select("id"), found, "x_"), "x_prediction_confidence")
