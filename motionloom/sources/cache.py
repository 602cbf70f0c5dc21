"""A cache of board observations: a partitioned table, and a manifest that says what was written with which board.

Observations of a recording are written first, each row with the number of its writing; then the manifest, which names
that number. A reader takes only rows of a writing that the manifest names, so a writing that broke off is never seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "camera_id string, connection_frame long, corner_id int, x double, y double, writing string, recording string"
MANIFEST = "kind string, squares_x int, squares_y int, square_mm double, dictionary string, first_frame long, last_frame long, n_cameras long, n_observations long, writing string, recording string"
KIND = "charuco"
#: Boards with squares that differ by no more (mm) are one.
SAME_SQUARE = 0.01


@dataclass(frozen=True)
class Board:
    squares_x: int
    squares_y: int
    square_mm: float
    dictionary: str


def write_cache(observations: DataFrame, folder: str, board: Board, kind: str = KIND) -> None:
    """Writes recording, camera_id, connection_frame, corner_id, x, y; recordings that were there before are replaced, others
    stay. A recording's rows are dealt by camera and frame, so that a long one has many writers and files."""
    writing = uuid.uuid4().hex
    rows = observations.select("recording", "camera_id", F.col("connection_frame").cast("long").alias("connection_frame"), F.col("corner_id").cast("int").alias("corner_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(writing).alias("writing"))
    dealt = rows.repartition("recording", "camera_id", F.floor(F.col("connection_frame") / 10000))
    (
        dealt.sortWithinPartitions("recording", "camera_id", "connection_frame")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording", "camera_id").parquet(f"{folder}/observations")
    )
    written = observations.sparkSession.read.schema(SCHEMA).parquet(f"{folder}/observations").where(F.col("writing") == writing)
    told = written.groupBy("recording", "writing").agg(
        F.min("connection_frame").alias("first_frame"), F.max("connection_frame").alias("last_frame"), F.count_distinct("camera_id").alias("n_cameras"), F.count("*").alias("n_observations")
    )
    named = {"kind": F.lit(kind), "squares_x": F.lit(board.squares_x), "squares_y": F.lit(board.squares_y), "square_mm": F.lit(float(board.square_mm)), "dictionary": F.lit(board.dictionary)}
    told.withColumns(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a recording that was written whole; empty where there is no cache."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def cache_status(spark: SparkSession, folder: str, board: Board, kind: str = KIND) -> DataFrame:
    """recording, writing, reason: why a recording's observations do not count (type or board), null if they do."""
    same = (F.col("squares_x") == board.squares_x) & (F.col("squares_y") == board.squares_y) & (F.abs(F.col("square_mm") - board.square_mm) <= SAME_SQUARE) & (F.col("dictionary") == board.dictionary)
    reason = F.when(~F.coalesce(F.col("kind") == kind, F.lit(False)), "type").when(~F.coalesce(same, F.lit(False)), "board")
    return manifest(spark, folder).select("recording", "writing", reason.alias("reason"))


def cached_observations(spark: SparkSession, folder: str, board: Board, kind: str = KIND, cameras: list[str] | None = None) -> DataFrame:
    """recording, camera_id, connection_frame, corner_id, x, y of the recordings whose board and type are as asked for."""
    good = cache_status(spark, folder, board, kind).where("reason is null").select("recording", "writing")
    if good.isEmpty():
        return spark.createDataFrame([], SCHEMA).drop("writing")
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/observations")
    rows = rows.where(F.col("camera_id").isin(cameras)) if cameras is not None else rows
    return rows.join(good, ["recording", "writing"], "left_semi").drop("writing")


def recalled(frame_map: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations by the frames of the recording, and the frames (recording, camera_id, frame) that must be detected anew.

    frame_map: recording, camera_id, frame, connection_frame. Each camera has its own numbers, so what one dropped never moves
    another's frames."""
    key = ["recording", "camera_id", "connection_frame"]
    hits = frame_map.join(cached, key).select("recording", "camera_id", "frame", "corner_id", "x", "y")
    misses = frame_map.join(cached.select(*key).distinct(), key, "left_anti").select("recording", "camera_id", "frame")
    return hits, misses
