"""Readers and writers of recordings: trajectories, timestamps, calibrations, observations, wire frames.

Column files are read by Spark with explicit schemas. Files of a rig's size (calibrations) are parsed on the
driver through Spark's own reader, so that any store Spark knows will do.
"""

from __future__ import annotations

import tomllib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYPOINTS_LONG = "frame long, keypoint string, model string, trajectory string, x double, y double, z double"
TRAJECTORY_CSV = "frame long, keypoint string, x double, y double, z double, model string, trajectory string"
CHARUCO_JSON = "camera_name string, frame_index int, corners array<struct<corner_id:int,pixel_xy:array<double>>>"
FRAME_MAP_CSV = "recording_frame_number long, connection_frame_number long"
STATS_JSON = "framerate_stats struct<median:double>"
COLUMNS = ["frame", "keypoint", "model", "trajectory", "x", "y", "z"]


def keypoints(spark: SparkSession, path: str, trajectory: str | None = "3d_xyz") -> DataFrame:
    """Long keypoint parquet: seven columns and, if named, one trajectory, both pushed to the scan."""
    df = spark.read.schema(KEYPOINTS_LONG).parquet(path).select(*COLUMNS)
    return df.where(F.col("trajectory") == trajectory) if trajectory else df


def first_readable(spark: SparkSession, folder: str, name: str, older: tuple[str, ...] = ()) -> str:
    """The recording's keypoint file: {name}_data.parquet, then the names of older layouts, then any parquet."""
    for pattern in (f"{name}_data.parquet", *older, "*.parquet"):
        try:
            spark.read.schema(KEYPOINTS_LONG).parquet(f"{folder}/{pattern}")
            return f"{folder}/{pattern}"
        except AnalysisException:
            continue
    raise FileNotFoundError(f"{folder} has no keypoint file")


def body_csv(spark: SparkSession, path: str) -> DataFrame:
    """frame, keypoint, x, y, z from a long or a wide ({name}_x, {name}_y, {name}_z) CSV; told by its header."""
    raw = spark.read.option("header", True).csv(path)
    if {"frame", "keypoint", "x", "y", "z"} <= set(raw.columns):
        return raw.select(F.col("frame").cast("long"), "keypoint", *[F.col(c).cast("double") for c in "xyz"])
    return wide_to_long(raw.withColumn("frame", F.monotonically_increasing_id()) if "frame" not in raw.columns else raw)


def wide_to_long(wide: DataFrame) -> DataFrame:
    names = [c[:-2] for c in wide.columns if c.endswith("_x") and f"{c[:-2]}_y" in wide.columns and f"{c[:-2]}_z" in wide.columns]
    if not names:
        raise ValueError("no columns named {name}_x, {name}_y and {name}_z")
    each = F.array(*[F.struct(F.lit(n).alias("keypoint"), *[F.col(f"`{n}_{c}`").cast("double").alias(c) for c in "xyz"]) for n in names])
    return wide.select(F.col("frame").cast("long"), F.explode(each).alias("p")).select("frame", "p.*")


def long_to_wide(points: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per frame (of the keys by) with {name}_x, {name}_y, {name}_z, of the given names: the pivot needs no pass to find them."""
    at = lambda n, c: F.max(F.when(F.col("keypoint") == n, F.col(c))).alias(f"{n}_{c}")
    return points.groupBy(*by, "frame").agg(*[at(n, c) for n in names for c in "xyz"])


def trajectory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strict: all seven headers, no row without frame or keypoint; rows without a position and faces are left out."""
    header = spark.read.option("header", True).csv(path).columns
    if lacking := sorted(set(COLUMNS) - set(header)):
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    df = spark.read.option("header", True).csv(path).select(*[F.col(c).cast("double" if c in "xyz" else "string").alias(c) for c in COLUMNS])
    bad = F.col("frame").isNull() | F.col("keypoint").isNull()
    df = df.withColumn("frame", F.when(bad, F.raise_error(F.lit("a row has no frame or no keypoint"))).otherwise(F.col("frame")).cast("long"))
    return df.where("x is not null and y is not null and z is not null").where(~F.lower("keypoint").contains("face"))


def blender_points(points: DataFrame, trajectory: str = "3d_xyz", scale: float = 0.001) -> DataFrame:
    """Points for an animation with y up: (x, -z, -y) scaled, frames from 1."""
    kept = points.where(F.col("trajectory") == trajectory)
    return kept.select((F.col("frame") + 1).alias("frame"), "keypoint", (F.col("x") * scale).alias("x"), (-F.col("z") * scale).alias("y"), (-F.col("y") * scale).alias("z"))


def timestamps_csv(spark: SparkSession, path: str) -> DataFrame:
    """row order and t from the first column whose name speaks of time."""
    raw = spark.read.option("header", True).csv(path)
    column = next((c for c in raw.columns for word in ("timestamp", "time", "elapsed", "seconds") if word in c.lower()), None)
    if column is None:
        raise ValueError(f"{path} has no time column")
    return raw.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{column}`").cast("double").alias("t"))


def frame_rates_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("`from_previous.framerate.hz`").cast("double").alias("hz"))


def frame_map_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(FRAME_MAP_CSV).csv(path)


def stats_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_JSON).option("multiLine", True).json(path).select(F.col("framerate_stats.median").alias("median"))


def charuco_json(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, frame, corner_id, x, y."""
    df = spark.read.schema(CHARUCO_JSON).option("multiLine", True).json(path)
    each = df.select(F.col("camera_name").alias("camera_id"), F.col("frame_index").cast("long").alias("frame"), F.explode("corners").alias("c"))
    return each.select("camera_id", "frame", "c.corner_id", F.col("c.pixel_xy")[0].alias("x"), F.col("c.pixel_xy")[1].alias("y"))


def calibration_toml(spark: SparkSession, path: str) -> DataFrame:
    """One row per camera: intrinsics (first four distortion terms), rotation matrix, translation and size."""
    from ..operators.calibration import rodrigues

    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    rows = []
    for key, cam in sorted((k, v) for k, v in tomllib.loads(text).items() if isinstance(v, dict) and "matrix" in v):
        (fx, _, cx), (_, fy, cy), _ = cam["matrix"]
        turn = rodrigues(np.array(cam["rotation"], float)).ravel().tolist()
        k1, k2, p1, p2 = ([*map(float, cam.get("distortions", [])), 0.0, 0.0, 0.0, 0.0])[:4]
        rows.append((cam.get("name", key), *map(float, (fx, fy, cx, cy)), k1, k2, p1, p2, *turn, *map(float, cam["translation"]), *map(int, cam["size"])))
    names = ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", *(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2"]
    return spark.createDataFrame(rows, "camera_id string, " + ", ".join(f"{n} double" for n in names) + ", width int, height int")


def calibration_text(cameras: list, metadata: dict | None = None) -> str:
    """TOML of cameras given as rows of calibration_toml."""
    from ..operators.calibration import rotation_vector

    out = []
    for n, c in enumerate(cameras):
        turn = np.array([[c[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        out += [
            f"[cam_{n}]", f'name = "{c["camera_id"]}"', f"size = [{c['width']}, {c['height']}]",
            f"matrix = [[{c['fx']!r}, 0.0, {c['cx']!r}], [0.0, {c['fy']!r}, {c['cy']!r}], [0.0, 0.0, 1.0]]",
            f"distortions = [{c['k1']!r}, {c['k2']!r}, {c['p1']!r}, {c['p2']!r}, 0.0]",
            f"rotation = {rotation_vector(turn).tolist()}", f"translation = [{c['t0']!r}, {c['t1']!r}, {c['t2']!r}]", "",
        ]
    return "\n".join([*out, "[metadata]", *(f"{k} = {v!r}" for k, v in (metadata or {}).items())]) + "\n"


def npy(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, point, values of (frames, points, n) arrays, one file a row at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    types = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("point", pa.int64()), ("values", pa.list_(pa.float64()))])

    def each(batches):
        import io

        for batch in batches:
            for row in batch.to_pylist():
                array = np.load(io.BytesIO(row["content"]), allow_pickle=False)
                array = array.reshape(array.shape[0], -1, array.shape[-1])
                for start in range(0, len(array), 1024):
                    part = array[start : start + 1024].astype(float)
                    f, p = np.divmod(np.arange(part.shape[0] * part.shape[1]), part.shape[1])
                    columns = [pa.array([row["path"]] * len(f)), pa.array(f + start), pa.array(p), pa.array(list(part.reshape(len(f), -1)), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, schema=types)

    return files.mapInArrow(each, "path string, frame long, point long, values array<double>")


def wire_frames(points: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, frame, payload: little-endian float32 x, y, z, visibility of every name in order, NaN and 0 where not seen; the data of
    one block of a message (`sources.wire` has the whole)."""
    at = F.map_from_entries(F.collect_list(F.struct("keypoint", F.array(*[F.col(c).cast("float") for c in "xyz"]).alias("at"))))
    frames = points.where("x is not null").groupBy(*by, "frame").agg(at.alias("at"))
    nothing = F.array(*[F.lit(v).cast("float") for v in (float("nan"),) * 3 + (0.0,)])
    one = F.array(F.lit(1.0).cast("float"))
    row = lambda n: F.coalesce(F.concat(F.try_element_at("at", F.lit(n)), one), nothing)
    flat = frames.select(*by, "frame", F.concat(*map(row, names)).alias("values"))
    keys = [*by, "frame"]

    def each(batches):
        for batch in batches:
            values = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tobytes() for v in values], pa.binary())], [*keys, "payload"])

    schema = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys)
    return flat.mapInArrow(each, f"{schema}, payload binary")


def payloads(points: DataFrame, com: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, frame, payload: JSON of a frame's keypoints and centre of mass, for a message sink."""
    listed = F.sort_array(F.collect_list(F.struct("keypoint", "x", "y", "z"))).alias("keypoints")
    keys = [*by, "frame"]
    frames = points.groupBy(*keys).agg(listed).join(com.select(*keys, F.struct("x", "y", "z").alias("center_of_mass")), keys, "left")
    return frames.select(*keys, F.to_json(F.struct("frame", "keypoints", "center_of_mass")).alias("payload"))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """recording, n_videos, bytes of every folder under root, newest name first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    inner = F.regexp_extract("path", r"/([^/]+)/(?:[^/]+/)*[^/]+$", 1) if not root else F.split(F.substring_index("path", root.rstrip("/").split(":")[-1] + "/", -1), "/")[0]
    is_video = F.lower("path").rlike(r"\.(mp4|avi|mov)$")
    return files.groupBy(inner.alias("recording")).agg(F.count_if(is_video).alias("n_videos"), F.sum("length").alias("bytes")).orderBy(F.desc("recording"))
