"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import sys
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.iterate import shared_folder

#: Bytes of a batch that goes to Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows without a doc_id take this one, so that they have a defined place: before all others.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this session's own only where a single machine names none."""
    named = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read again: columnar, so that later readers prune."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def crc32(data: bytes) -> int:
    import zlib

    return zlib.crc32(data) & 0xFFFFFFFF


def held_out() -> Column:
    """Rows that no classifier learns from: crc32 of the decimal doc_id divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def release(keep: str = "") -> None:
    """Frees what other operators remember in this Python worker, which runs the tasks of one after another, and hands freed memory back."""
    for name, clear in (("bpe", "encoder.cache_clear"), ("lm", "_HASHES.clear")):
        module = sys.modules.get(f"evidentia.llm.{name}")
        if module is not None and name != keep:
            for part in clear.split("."):
                module = getattr(module, part)
            module()
    trim()


def frugal(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """The function of a task's batches, with ``release`` before it and ``trim`` after it: workers wait for their next task with little memory."""

    def run_and_trim(batches: Iterator) -> Iterator:
        release(keep)
        try:
            yield from run(batches)
        finally:
            trim()

    return run_and_trim


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python some megabytes at a time, whatever their length, unless the session says otherwise."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def trim() -> None:
    """Hands memory that is free within this process back to the machine, where the C library can."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
