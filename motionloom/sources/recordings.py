"""Recording folders as tables: what lies in them, and everything known of a recording in one row.

A folder of recordings is listed by Spark (paths and lengths alone); small files of all recordings are read in one scan and
parsed where they lie. Parts that a recording lacks, or that cannot be read, are null.
"""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the body file that counts before all others.
PREFERRED_BODY = "mediapipe_body_3d_xyz.csv"
VIDEO = r"\.(mp4|avi|mov|mkv)$"
POSE = ["px", "py", "pz", *(f"w{i}{j}" for i in range(3) for j in range(3))]
#: What files of old layouts were called, and what they are called now.
OLD_NAMES = {
    "mediapipe2dData_numCams_numFrames_numTrackedPoints_pixelXY.npy": "mediapipe_2dData_numCams_numFrames_numTrackedPoints_pixelXY.npy",
    "mediapipe3dData_numCams_numFrames_numTrackedPoints_reprojectionError.npy": "mediapipe_3dData_numCams_numFrames_numTrackedPoints_reprojectionError.npy",
    "mediapipe3dData_numFrames_numTrackedPoints_reprojectionError.npy": "mediapipe_3dData_numFrames_numTrackedPoints_reprojectionError.npy",
    "mediapipe3dData_numFrames_numTrackedPoints_spatialXYZ.npy": "mediapipe_3dData_numFrames_numTrackedPoints_spatialXYZ.npy",
    "mediaPipeSkel_3d_body_hands_face.npy": "mediapipe_skeleton_3d.npy",
    "segmentCOM_frame_joint_xyz.npy": "mediapipe_segmentCOM_frame_joint_xyz.npy",
    "total_body_center_of_mass_xyz.npy": "mediapipe_total_body_center_of_mass_xyz.npy",
}


def _within(root: str) -> tuple[Column, Column]:
    """Recording and path within it."""
    inner = F.substring_index(F.col("path"), re.sub(r"^\w+:", "", root).strip("/") + "/", -1)  # schemes are written with one slash or three
    return F.split(inner, "/")[0], F.regexp_replace(inner, "^[^/]+/", "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """recording, file (path within the recording), bytes, changed of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    recording, file = _within(root)
    return files.select(recording.alias("recording"), file.alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def present_name(file: Column) -> Column:
    """The path of a file of an old layout with the name that it has today; other paths stay."""
    name = F.substring_index(file, "/", -1)
    known = F.create_map(*[F.lit(v) for pair in OLD_NAMES.items() for v in pair])
    return F.coalesce(F.concat(F.left(file, F.length(file) - F.length(name)), F.try_element_at(known, name)), file)


def body_csv(files: DataFrame) -> DataFrame:
    """recording, body_csv: the preferred body file, else the first by path whose name ends in body_3d_xyz.csv."""
    name = F.substring_index("file", "/", -1)
    found = files.where(name.endswith("body_3d_xyz.csv"))
    return found.groupBy("recording").agg(F.min(F.struct((name != PREFERRED_BODY).alias("other"), "file")).alias("b")).select("recording", F.col("b.file").alias("body_csv"))


def _contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """recording, file, content of the small files whose path within a recording matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    recording, file = _within(root)
    return files.select(recording.alias("recording"), file.alias("file"), "content").where(F.col("file").rlike(pattern))


def frame_counts(spark: SparkSession, root: str) -> DataFrame:
    """recording, camera_id, n_frames: the rows of each camera's timestamps (timestamps/<camera>.csv), however many files of
    however many rows there are."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value")
    recording, file = _within(root)
    named = rows.select(recording.alias("recording"), file.alias("file"), "value").where(F.col("file").rlike(r"(^|/)timestamps/[^/]+\.csv$"))
    camera = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    return named.groupBy("recording", camera.alias("camera_id")).agg((F.count_if(F.trim("value") != "") - 1).alias("n_frames"))


def camera_poses(spark: SparkSession, root: str) -> DataFrame:
    """recording, camera_id, px, py, pz, w00 to w22, width, height of the calibrated cameras that have a place in the world. A
    file that cannot be read gives no rows; of a recording's calibrations the one with the first path counts."""
    found = _contents(spark, root, r"calibration[^/]*\.toml$")
    first = found.groupBy("recording").agg(F.min_by("content", "file").alias("content"))

    def parse(batches):
        for batch in batches:
            out = []
            for recording, content in zip(batch["recording"], batch["content"], strict=True):
                try:
                    told = tomllib.loads(bytes(content).decode("utf-8"))
                    for key, cam in told.items():
                        if key != "metadata" and isinstance(cam, dict) and "world_position" in cam and "world_orientation" in cam:
                            turn = [float(v) for row in cam["world_orientation"] for v in row]
                            size = cam.get("size") or [None, None]
                            out.append((recording, str(cam.get("name", key)), *map(float, cam["world_position"]), *turn, *size))
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["recording", "camera_id", *POSE, "width", "height"])

    return first.mapInPandas(parse, "recording string, camera_id string, " + ", ".join(f"{c} double" for c in POSE) + ", width int, height int")


def tracker_schemas(spark: SparkSession, root: str) -> DataFrame:
    """recording, name, tracker_type, tracked_points, connections of every recording that has a file; the fallback (no points)
    for those without, or whose file cannot be read."""
    files = listing(spark, root).select("recording").distinct()
    found = _contents(spark, root, r"^tracker_schema\.json$").select("recording", F.col("content").cast("string").alias("text"))
    kind = "name string, tracker_type string, tracked_points array<string>, connections array<array<string>>"
    told = files.join(found, "recording", "left").withColumn("s", F.from_json("text", kind))
    empty = lambda t: F.array().cast(t)
    return told.select(
        "recording", F.coalesce("s.name", F.lit("fallback")).alias("name"), F.coalesce("s.tracker_type", F.lit("unknown")).alias("tracker_type"),
        F.coalesce("s.tracked_points", empty("array<string>")).alias("tracked_points"), F.coalesce("s.connections", empty("array<array<string>>")).alias("connections"),
    )


def schema_text(name: str, tracker_type: str, points: list[str], connections: list[tuple[str, str]]) -> str:
    return json.dumps({"name": name, "tracker_type": tracker_type, "tracked_points": points, "connections": [list(c) for c in connections]})


def bundles(spark: SparkSession, root: str) -> DataFrame:
    """One row a recording, newest name first: n_files, n_videos, bytes, body_csv, n_cameras and n_frames of its timestamps (null
    where they differ), in_sync, posed_cameras, tracker; parts that are not there are null."""
    files = listing(spark, root)
    sizes = files.groupBy("recording").agg(F.count("*").alias("n_files"), F.count_if(F.lower("file").rlike(VIDEO)).alias("n_videos"), F.sum("bytes").alias("bytes"))
    counts = frame_counts(spark, root).groupBy("recording").agg(
        F.count("*").alias("n_cameras"), (F.min("n_frames") == F.max("n_frames")).alias("in_sync"), F.when(F.min("n_frames") == F.max("n_frames"), F.max("n_frames")).alias("n_frames")
    )
    posed = camera_poses(spark, root).groupBy("recording").agg(F.array_sort(F.collect_list("camera_id")).alias("posed_cameras"))
    tracker = tracker_schemas(spark, root).where("name <> 'fallback'").select("recording", F.col("name").alias("tracker"))
    whole = sizes
    for part in (body_csv(files), counts, posed, tracker):
        whole = whole.join(part, "recording", "left")
    return whole.orderBy(F.desc("recording"))


def save_everywhere(spark: SparkSession, text: str, recording_folder: str, calibrations_folder: str, name: str) -> list[str]:
    """Writes a calibration's text into the recording, among all calibrations and as the last that succeeded; each by way of a
    file beside it, so that no reader sees half of one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    places = [f"{recording_folder}/{name}.toml", f"{calibrations_folder}/{name}.toml", f"{calibrations_folder}/last_successful_calibration.toml"]
    for place in places:
        there, beside = jvm.org.apache.hadoop.fs.Path(place), jvm.org.apache.hadoop.fs.Path(f"{place}.writing")
        system = there.getFileSystem(conf)
        out = system.create(beside, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        system.delete(there, False)
        system.rename(beside, there)
    return places
