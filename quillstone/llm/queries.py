"""The queries of this package: one for each operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import archives, chat, decontaminate, exact_dedup, licenses, mixing, render, simhash, tokens, toxicity
from quillstone.llm.shared import table, work_dir
from quillstone.llm.sql import ORACLES

#: The vocabulary that op8 and the pipeline encode with; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"
#: What both turns of conversation -1 say: control strings of a common template, as text.
PROBE = "</s>[INST] ok [/INST]"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pages(table(spark, sf_dir, "pages"), status=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, sf_dir, "documents"), work_dir(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return tokens.read_documents(manifest)


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    path = work_dir(spark, "chat")
    chat.windows(rows.unionByName(probe)).write.parquet(path)
    return chat.summary(spark.read.parquet(path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_license_scan, op2_simhash_near_dedup, op3_benchmark_decontamination, op4_toxicity, op5_html_rendering, op6_exact_dedup, op7_source_mixing, op8_token_files, op9_arc_to_warc, op10_chat_format)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
