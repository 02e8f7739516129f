"""Exact deduplication as a stream with disk-backed keyed state.

Two streams, each run to the end of what is there and resumable from its own checkpoint,
in one home folder:

1. documents -> log: one row per document with SHA-256 of its normalised text (A-Z
   lower-cased, UTF-8), id, and content locator (file and row in it). No text is kept.
2. log -> state: a streaming aggregation in RocksDB without expiry, keyed by digest and
   length: stable id and locator of the row that stays, and the group's size. Spark sums
   up each task's rows by key before it deals them out, so a text that a third of all
   rows share costs one row per task. Every batch writes the keys that it changed.

A later call with new files under the same path goes on from the state. Each stream takes
FILES_PER_BATCH files at a time, so a lost run goes on with the batch that it was in. The
number of the state's partitions is spark.sql.shuffle.partitions when a home is first used;
it stays with the home, so set it for the rows that are to come.

Full bytes: for every group of two rows or more, the texts are fetched by locator and each
member is compared, byte by byte, with the row that stays. That row's text goes to a task for
every HIT_ROWS members, so no task has all copies of one text. Members that differ (two texts
of one digest) are then grouped by their whole texts, so that a collision costs time and
never a document.

Defined results: null text counts as empty; of equal texts the row with the largest
doc_id stays, null lowest, ties by locator; repeated rows are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: State on disk; batches upload their changes alone; a store's files take the room they fill, not what RocksDB sets aside.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Files that a batch of either stream takes.
FILES_PER_BATCH = 2000
#: Members of a group that one task compares with the row that stays.
HIT_ROWS = 256
LOG = "doc_id long, path string, row long, sha binary, bytes long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """LOG rows of docs that were read from files (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or b"").lower() for t in b.column(3)]
            shas = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], shas, pa.array(map(len, texts), pa.int64())], ["doc_id", "path", "row", "sha", "bytes"])

    place = docs.select(F.col("doc_id").cast("long"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col("text").cast("binary").alias("text"))
    return place.mapInArrow(run, LOG)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The folder that a stream reads, and the name in it if path is a single file."""
    one = spark.read.parquet(path).select("_metadata.file_path").first()[0]
    bare = lambda uri: unquote(urlparse(uri).path).rstrip("/")
    return path.rstrip("/").rsplit("/", 1) if bare(one) == bare(path) else (path, None)


def _written(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch in a folder of its own; a batch that is run again replaces what it left."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def ingest(spark: SparkSession, path: str, home: str, digest_bytes: int = 32, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Brings log and state in home up to date with the Parquet files at path, of which there is at least one row."""
    folder, name = _folder(spark, path)
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    docs = docs.option("pathGlobFilter", name).parquet(folder) if name else docs.parquet(folder)
    log = digests(docs).writeStream.format("parquet").option("checkpointLocation", f"{home}/log-progress").trigger(availableNow=True)
    log.start(f"{home}/log").awaitTermination()
    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/log")
    held = rows.groupBy(F.substring("sha", 1, digest_bytes).alias("digest"), "bytes").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count("*").alias("n"))
    with _settings(spark, STATE):
        state = held.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
        state.foreachBatch(_written(f"{home}/groups")).start().awaitTermination()


def groups(spark: SparkSession, home: str) -> DataFrame:
    """(digest, bytes, keep, n) of each key, as of its last change; keep and n only ever grow."""
    schema = "digest binary, bytes long, keep struct<doc_id: long, path: string, row: long>, n long"
    return spark.read.schema(schema + ", batch long").parquet(f"{home}/groups").groupBy("digest", "bytes").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def deduplicate(spark: SparkSession, path: str, home: str | None = None, digest_bytes: int = 32, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, path, row) for every document at path."""
    home = home or work_dir(spark, "exact-dedup")
    empty = spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, path string, row long")
    if spark.read.parquet(path).select("doc_id").isEmpty():
        return empty
    ingest(spark, path, home, digest_bytes, files_per_batch)
    log = spark.read.schema(LOG).parquet(f"{home}/log").withColumn("digest", F.substring("sha", 1, digest_bytes))
    # cut, so that the join is of two plain exchanges, of which Spark can split a hot digest's
    held = log.join(cut(groups(spark, home)), ["digest", "bytes"])
    is_keep = lambda: (F.col("path") == F.col("keep.path")) & (F.col("row") == F.col("keep.row"))
    out = held.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), is_keep().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "path", "row", "digest", "bytes",
    )

    # full bytes of every hit against the row that stays
    salts = F.ceil(F.col("n") / HIT_ROWS).cast("int")
    members = held.where("n > 1").select("path", "row", "digest", "bytes", is_keep().alias("kept"), salts.alias("salts"))
    docs = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), "text")
    texts = docs.join(members, ["path", "row"]).select("digest", "bytes", "kept", "salts", "path", "row", F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(texts)
    stays = texts.where("kept").select("digest", "bytes", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("stays"))
    others = texts.where("not kept").select("digest", "bytes", F.pmod(F.xxhash64("path", "row"), F.col("salts")).cast("int").alias("salt"), "text")
    same = F.when(F.col("text") == F.col("stays"), True).otherwise(normalised(F.col("text")) == normalised(F.col("stays")))
    differ = cut(cut(others.join(stays, ["digest", "bytes", "salt"]).where(~same).select("digest", "bytes")).distinct())
    if differ.isEmpty():
        return out.drop("digest", "bytes")
    # texts that share a digest: grouped by their whole texts
    mixed = texts.join(differ, ["digest", "bytes"], "left_semi").select("path", "row", normalised(F.col("text")).alias("norm"))
    mixed = mixed.join(log.select("path", "row", "doc_id", "sha"), ["path", "row"])
    whole = mixed.groupBy("norm").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count("*").alias("n"))
    again = mixed.join(whole, "norm").select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), is_keep().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "path", "row")
    return out.join(differ, ["digest", "bytes"], "left_anti").drop("digest", "bytes").unionByName(again)
