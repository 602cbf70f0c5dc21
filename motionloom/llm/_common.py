"""Helpers shared by the corpus operators: tables, checkpoints, words and folds."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: As ASCII_LOWER; bytes that cannot be part of a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Names a checkpoint folder and keeps Arrow batches small enough for long texts.

    A cluster names the folder in spark.checkpoint.dir; only where all runs on this machine (local tests) and
    nothing is set, a temporary folder stands in.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1024:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    return ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: cuts lineage and is read by all executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, UPPER_AZ.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array) -> Iterable[str]:
    """Texts of an Arrow column one by one; null is empty."""
    for value in column:
        yield value.as_py() or ""


def release() -> None:
    """Hands memory that a task no longer uses back to the system: workers live on and hold it beside later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else os.path.normpath(path.removeprefix("file:"))
