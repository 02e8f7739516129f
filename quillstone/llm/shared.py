"""What the operators of this package share: tables, the shared work folder, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package (as the inside of a regex class).
ASCII_SPACE = r"\x20\x09-\x0D"
#: One word, as a regex that Java and RE2 read alike.
WORD = rf"[^{ASCII_SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by names in which nulls are equal; the keys stay once."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see.

    Only a local master, where all is one machine, gets a temporary folder when the
    setting is missing; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def one_per_task(rows: DataFrame) -> DataFrame:
    """A small table of paths, each in a task of its own as far as may be; Spark would put small rows together."""
    return rows.repartition(max(1, rows.count()))


#: What a Python worker remembers from task to task.
_remembered: dict = {}


def remembered(key: tuple, make: Callable):
    """What `make` gave for this key in an earlier task of the worker, or gives now; only the last key is held."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    _remembered.clear()


def freeing(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end, as its Python worker lives on beside the next tasks.

    Unless it `keeps` them, it first forgets what tasks of another kind have left remembered.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI or path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def publish(system: fs.FileSystem, part: str, final: str) -> None:
    """Puts a finished file in its place. Attempts of a task write the same, so one that finds the place taken leaves it."""
    if system.get_file_info(final).type == fs.FileType.File:
        system.delete_file(part)
        return
    try:
        system.move(part, final)
    except OSError:
        if system.get_file_info(final).type != fs.FileType.File:
            raise
        system.delete_file(part)
