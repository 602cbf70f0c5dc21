"""Replayed streams: tables as files in order of time, and streaming queries run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of a replayed stream, about.
ROWS_A_FILE = 250_000
#: Recordings that share a state at most (a power of two).
RECORDINGS_A_STATE = 64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one only where all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="streams-")
    return f"{named}/{name}-{uuid.uuid4().hex}"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB, as stateful processors need; the caller's stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def replayed(rows: DataFrame, ts: str, slices: int, session: SparkSession | None = None) -> DataFrame:
    """A stream of rows as they came: `slices` spans of equal length of `ts`, one micro-batch each, in order.

    rows are worked out once. Every slice has the same number of files (empty ones make it up), some ROWS_A_FILE rows each, so
    that many tasks write and read it, and a trigger takes just its files."""
    spark = session or rows.sparkSession
    folder = shared_folder(rows.sparkSession, "replay")
    staged = f"{folder}-staged"
    rows.write.parquet(staged)
    told, kind = rows.sparkSession.read.schema(rows.schema).parquet(staged), rows.schema
    micros = F.unix_micros(ts)
    lo, hi, n = told.agg(F.min(micros), F.max(micros), F.count("*")).first()
    part = F.floor((micros - (lo or 0)) * slices / ((hi or 0) - (lo or 0) + 1))
    files = max(1, -(-n // (slices * ROWS_A_FILE)))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(slices):  # files of later slices are younger, which is the order in which a file stream reads them
        told.where(part == k).repartition(files).write.mode("append").parquet(folder)
        there = sum(f.getPath().getName().startswith("part-") for f in system.listStatus(place))
        for _ in range(files * (k + 1) - there):
            rows.sparkSession.createDataFrame([], kind).coalesce(1).write.mode("append").parquet(folder)
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(folder)


def played(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table of files and returns that table."""
    folder = shared_folder(spark, "played")
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def together(recording: str = "recording"):
    """The key of a state: recordings of neighbouring numbers, RECORDINGS_A_STATE at most, share one, as each call of a state's
    function costs milliseconds whatever it holds. A state stays bounded by what its few recordings hold."""
    return F.shiftright(recording, RECORDINGS_A_STATE.bit_length() - 1)
