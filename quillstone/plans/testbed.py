"""The driver's tables as inputs of the operators, in Spark and as common table expressions for DuckDB.

Cells are orders, genes are parts, values are quantities; classes are the labels of the embeddings,
placed in a small vocabulary with one class of two parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = [
    ("L0", "A"), ("L1", "A"), ("L2", "B"), ("L3", "B"), ("L4", "B"), ("L4", "C"), ("L5", "C"), ("L6", "C"),
    ("L7", "D"), ("L8", "D"), ("L9", "D"), ("A", "E"), ("B", "E"), ("D", "C"), ("C", "R"), ("E", "R"),
]


class Testbed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def expr(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))

    @property
    def coarse(self) -> DataFrame:
        """Fewer genes, so that each meets many cells."""
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 40).alias("gene")).agg(F.sum("l_quantity").alias("value"))

    @property
    def cells(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("cell"))

    @property
    def labels(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("label"))

    @property
    def sampled(self) -> DataFrame:
        return self.labels.join(self.table("orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 5).alias("sample")), "cell")

    @property
    def rows(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label")).alias("label"), F.col("embedding").cast("array<double>").alias("z"))

    @property
    def edges(self) -> DataFrame:
        return self.spark.createDataFrame(EDGES, "child string, parent string")

    @property
    def counts(self) -> DataFrame:
        return self.rows.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n"))

    @property
    def events(self) -> DataFrame:
        """(lineage, id, rank, gene, value, covariate, type): events in order, their hour as gene."""
        return self.table("events").select(
            F.col("event_type").alias("lineage"), F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("rank"),
            (F.col("user_id") % 7).alias("gene"), F.round("value", 3).alias("value"), (F.col("user_id") % 13).cast("double").alias("covariate"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("type"),
        )


EXPR = "expr AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
COARSE = "coarse AS (SELECT l_orderkey AS cell, l_partkey % 40 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
LABELS = "lab AS (SELECT o_orderkey AS cell, o_orderpriority AS label, o_custkey % 5 AS sample FROM orders)"
ROWS = "rows AS (SELECT vec_id AS id, 'L' || label AS label, embedding::DOUBLE[] AS z FROM embeddings)"
PROTOS = """parts AS (SELECT label, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM rows),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
protos AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label)"""
SIMS = "sims AS (SELECT id, p.label, r.label AS own, list_cosine_similarity(z, v) AS sim FROM rows r, protos p)"
EDGES_SQL = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in EDGES) + ") AS e(child, parent))"
NODES = "nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges)"
UP = f"""{EDGES_SQL}, {NODES},
ways(node, ancestor, steps) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT w.node, e.parent, w.steps + 1 FROM ways w JOIN edges e ON e.child = w.ancestor),
up AS (SELECT node, ancestor, min(steps) AS shortest, max(steps) AS longest FROM ways GROUP BY 1, 2),
roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM edges)),
depth AS (SELECT node, min(shortest) AS shortest, max(longest) AS longest FROM up WHERE ancestor IN (SELECT node FROM roots) GROUP BY node)"""
COUNTS = "counts AS (SELECT 'L' || label AS node, count(*) AS n FROM embeddings GROUP BY 1)"
KNN = "knn AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.z, b.z), 9) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.z, b.z), 9) DESC, b.id) AS rank FROM rows a JOIN rows b ON a.id != b.id) WHERE rank <= 10)"
EVENTS = "ev AS (SELECT event_type AS lineage, event_id AS id, event_id::DOUBLE AS rank, user_id % 7 AS gene, round(value, 3) AS value, (user_id % 13)::DOUBLE AS covariate, 'u' || (user_id % 9) AS type FROM events)"
