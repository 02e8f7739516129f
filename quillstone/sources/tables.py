"""Readers of the text formats that measurement tables, gene sets and vocabularies come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def market_matrix(spark: SparkSession, matrix: str, features: str, barcodes: str, sample: str | None = None) -> DataFrame:
    """(cell, gene, value) of a coordinate matrix (genes by cells) with its features and barcodes, plain or gzipped.

    Cells are named sample_barcode; entries are numbered from 1 and joined to the names by number.
    """

    def numbered(path: str) -> DataFrame:
        # one file is one partition of text for these small lists, so a line's place is its id
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
        return lines.select(F.row_number().over(Window.orderBy("at")).alias("n"), F.split("value", "\t").alias("f"))

    rows = spark.read.text(matrix).where("not startswith(value, '%')").select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("at"))
    head = rows.agg(F.min("at").alias("first"))
    entries = rows.join(F.broadcast(head)).where("at > first").select(F.col("f")[0].cast("long").alias("g"), F.col("f")[1].cast("long").alias("c"), F.col("f")[2].cast("double").alias("value"))
    genes = numbered(features).select(F.col("n").alias("g"), F.col("f")[0].alias("gene"))
    name = F.col("f")[0] if sample is None else F.concat(F.lit(sample + "_"), F.col("f")[0])
    cells = numbered(barcodes).select(F.col("n").alias("c"), name.alias("cell"))
    return entries.join(genes, "g").join(cells, "c").select("cell", "gene", "value")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, gene) of GMT lines: name, description, genes; the description is the term's id if it looks like one."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) != ''").select(f[0].alias("name"), f[1].alias("about"), F.explode(F.slice(f, 3, F.size(f))).alias("gene"))
    term = F.when(F.col("about").contains(":") | F.col("about").startswith("R-"), F.col("about")).otherwise(F.col("name"))
    return lines.where("gene != ''").select(term.alias("term"), "name", "gene").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent) of an OBO file: its id and is_a lines. One file is read as one split, so that lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", r"(?m)^(?=id:)"), 2, 1_000_000_000)).alias("block"))
    child = F.regexp_extract("block", r"^id:\s*(\S+)", 1)
    return lines.select(child.alias("child"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^is_a:\s*([^\s!]+)"), 1)).alias("parent")).distinct()


def developmental_order(spark: SparkSession, path: str) -> DataFrame:
    """(earlier, later) of a tab-separated file with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="earlier string, later string")
