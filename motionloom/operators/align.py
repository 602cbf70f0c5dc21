"""Frames across cameras: completeness, missing frames, shared observations and frame maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(obs: DataFrame, cameras: int, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by, n_cameras, complete: whether all cameras have the frame. by: the keys of a frame, as recording and frame."""
    return obs.groupBy(*by).agg(F.count_distinct("camera_id").alias("n_cameras")).withColumn(
        "complete", F.col("n_cameras") == cameras
    )


def missing(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, frame, camera_id) of the grid of a recording's seen frames and seen cameras that no observation has.

    The grid is built on frames with at least one camera missing only, so complete recordings cost an aggregate.
    """
    cameras = obs.groupBy(*by).agg(F.sort_array(F.collect_set("camera_id")).alias("all_cameras"))  # one name per camera
    of_frame = obs.groupBy(*by, "frame").agg(F.collect_set("camera_id").alias("have"))
    both = of_frame.join(cameras, list(by)) if by else of_frame.join(F.broadcast(cameras))
    return both.select(*by, "frame", F.explode(F.array_except("all_cameras", "have")).alias("camera_id"))


def by_frame(obs: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row per frame with a map from camera to value; absent cameras are absent keys."""
    entries = F.sort_array(F.collect_list(F.struct("camera_id", "value")))
    return obs.groupBy(*by).agg(F.map_from_entries(entries).alias("cameras"))


def cached(frames: DataFrame, cache: DataFrame) -> DataFrame:
    """Recording frames whose connection frame is in the cache of their camera."""
    return frames.join(cache, ["camera_id", "connection_frame"])


def uncached(frames: DataFrame, cache: DataFrame) -> DataFrame:
    return frames.join(cache, ["camera_id", "connection_frame"], "left_anti")


def camera_pairs(obs: DataFrame, key: str = "frame", by: tuple[str, ...] = ()) -> DataFrame:
    """by, key, cam_a, cam_b (cam_a < cam_b) for every two cameras that share a key. by: keys of a recording.

    A key has at most one entry per camera after the set is collected, so pairs grow with cameras squared (tens), not with
    observations.
    """
    seen = obs.groupBy(*by, key).agg(F.sort_array(F.collect_set("camera_id")).alias("cams"))
    a = seen.select(*by, key, "cams", F.posexplode("cams").alias("i", "cam_a"))
    return a.select(*by, key, "cam_a", F.explode(F.slice("cams", F.col("i") + 2, F.size("cams"))).alias("cam_b"))


def shared_counts(obs: DataFrame, key: str = "frame", by: tuple[str, ...] = ()) -> DataFrame:
    return camera_pairs(obs, key, by).groupBy(*by, "cam_a", "cam_b").agg(F.count("*").alias("n_shared"))


def same_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids that only one side has, with the side; empty if the sets agree."""
    only_a = a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti").withColumn("only_in", F.lit("a"))
    only_b = b.select(column).distinct().join(a.select(column).distinct(), column, "left_anti").withColumn("only_in", F.lit("b"))
    return only_a.unionByName(only_b)


def match_camera(data: DataFrame, cameras: DataFrame) -> DataFrame:
    """data_key to camera_id: equal ids first, else equal numbers in the names. cameras is a short list, broadcast."""
    from ..functions.names import camera_index

    known = F.broadcast(cameras.select("camera_id", camera_index(F.col("camera_id")).alias("_n")))
    exact = data.join(F.broadcast(cameras.select("camera_id")), F.col("data_key") == F.col("camera_id"))
    rest = data.join(F.broadcast(cameras.select(F.col("camera_id").alias("data_key"))), "data_key", "left_anti")
    by_number = rest.withColumn("_n", camera_index(F.col("data_key"))).join(known, "_n").drop("_n")
    return exact.select("data_key", "camera_id").unionByName(by_number.select("data_key", "camera_id"))


def match_camera_strictly(data: DataFrame, cameras: DataFrame) -> DataFrame:
    """As `match_camera`; the query fails at a key that no camera fits."""
    found = match_camera(data, cameras)
    all_ = data.select("data_key").distinct().join(found, "data_key", "left")
    fail = F.raise_error(F.concat(F.lit("no camera fits "), "data_key"))
    return all_.select("data_key", F.when(F.col("camera_id").isNotNull(), F.col("camera_id")).otherwise(fail).alias("camera_id"))


def match_by_part(data: DataFrame, cameras: DataFrame) -> DataFrame:
    """data_key, camera_id where the name of a calibrated camera is part of the key; of several the longest name. cameras is a
    short list, broadcast."""
    names = F.broadcast(cameras.select("camera_id"))
    met = data.join(names, F.contains("data_key", "camera_id"))
    best = F.max_by("camera_id", F.struct(F.length("camera_id"), "camera_id"))
    return met.groupBy("data_key").agg(best.alias("camera_id"))


def frame_at(t: Column, fps: Column | float) -> Column:
    """Number of the frame that shows at t seconds."""
    return F.floor(t * fps).cast("long")


def captured(frames: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """Frames within a recording window of their key. windows: by, start, stop (null: still open), few to a key."""
    inside = (F.col("t") >= F.col("start")) & (F.col("stop").isNull() | (F.col("t") < F.col("stop")))
    return frames.join(windows, by).where(inside)


def sampled(*samples: DataFrame) -> DataFrame:
    """The union of samples of frames, each frame once."""
    union = samples[0]
    for other in samples[1:]:
        union = union.unionByName(other)
    return union.distinct()


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ids 0, 1, 2 ... in the order of the distinct values of a column with few of them (a board's or a rig's)."""
    values = F.array_sort(F.collect_set(column))
    listed = df.agg(values.alias("_all"))
    return df.join(F.broadcast(listed)).withColumn(out, F.array_position("_all", F.col(column)).cast("long") - 1).drop("_all")


def on_board(corners: DataFrame, board: DataFrame) -> DataFrame:
    """Corners with their place on the board (corner_id, bx, by); the board is a fixed table."""
    return corners.join(F.broadcast(board), "corner_id")


def all_corners(corners: DataFrame, board: DataFrame, by: list[str]) -> DataFrame:
    """A row for every corner of the board in every view of `by`, with nulls where it was not seen."""
    grid = corners.select(*by).distinct().join(F.broadcast(board.select("corner_id")))
    return grid.join(corners, [*by, "corner_id"], "left")


def adjustment_points(corners: DataFrame, min_corners: int = 6, min_cameras: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Corners to adjust a rig with: of views (by, frame, camera_id) with min_corners of them, those that min_cameras such
    views of a frame share. by: keys of a recording."""
    view, point = [*by, "frame", "camera_id"], [*by, "frame", "corner_id"]
    rich = corners.groupBy(*view).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_corners).drop("_n")
    kept = corners.join(rich, view, "left_semi")
    shared = kept.groupBy(*point).agg(F.count_distinct("camera_id").alias("_n")).where(F.col("_n") >= min_cameras).drop("_n")
    return kept.join(shared, point, "left_semi")
