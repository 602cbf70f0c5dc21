"""Sinks and sources: observation cache, binary messages, arrays in two phases."""

import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionloom.sources import cache, npy, wire

BOARD = cache.Board(7, 5, 58.0, "DICT_4X4_250")


def observations(spark, by_camera, recording="r1"):
    rows = [(recording, camera, n, corner, float(n), float(corner)) for camera, frames in by_camera.items() for n in frames for corner in (0, 3)]
    return spark.createDataFrame(rows, "recording string, camera_id string, connection_frame long, corner_id int, x double, y double")


def frame_map(spark, cameras, n, recording="r1"):
    return spark.createDataFrame([(recording, c, i, 100 + i) for c in cameras for i in range(n)], "recording string, camera_id string, frame long, connection_frame long")


def frames(df, camera):
    return {r.frame for r in df.where(F.col("camera_id") == camera).collect()}


def test_cache_aligns_each_camera_by_its_own_frames(spark, tmp_path):
    folder = str(tmp_path / "cache")
    cache.write_cache(observations(spark, {"cam0": [100, 102, 104], "cam1": [100, 101, 104]}), folder, BOARD)
    hits, misses = cache.recalled(frame_map(spark, ["cam0", "cam1", "cam2"], 5), cache.cached_observations(spark, folder, BOARD))
    assert (frames(hits, "cam0"), frames(hits, "cam1"), frames(hits, "cam2")) == ({0, 2, 4}, {0, 1, 4}, set())
    assert (frames(misses, "cam0"), frames(misses, "cam1"), frames(misses, "cam2")) == ({1, 3}, {2, 3}, {0, 1, 2, 3, 4})
    assert hits.where("camera_id = 'cam0' and frame = 2 and corner_id = 3").first().x == 102.0  # under the number of the recording
    m = cache.manifest(spark, folder).first()
    assert (m.first_frame, m.last_frame, m.n_cameras, m.n_observations) == (100, 104, 2, 12)


def test_cache_of_another_board_or_type_is_rejected(spark, tmp_path):
    folder = str(tmp_path / "cache")
    cache.write_cache(observations(spark, {"cam0": [100]}), folder, BOARD)
    cache.write_cache(observations(spark, {"cam0": [7]}, "r2"), folder, BOARD, kind="mediapipe")
    status = {r.recording: r.reason for r in cache.cache_status(spark, folder, BOARD).collect()}
    assert status == {"r1": None, "r2": "type"}
    for other in (cache.Board(5, 3, 58.0, "DICT_4X4_250"), cache.Board(7, 5, 57.0, "DICT_4X4_250"), cache.Board(7, 5, 58.0, "DICT_5X5_250")):
        assert cache.cached_observations(spark, folder, other).count() == 0
        assert {r.reason for r in cache.cache_status(spark, folder, other).collect()} == {"board", "type"}
    assert cache.cached_observations(spark, folder, cache.Board(7, 5, 58.009, "DICT_4X4_250")).count() == 2
    assert cache.cached_observations(spark, str(tmp_path / "none"), BOARD).count() == 0


def test_cache_replaces_a_recording_and_hides_broken_writings(spark, tmp_path):
    folder = str(tmp_path / "cache")
    cache.write_cache(observations(spark, {"cam0": [1, 2], "cam1": [1]}), folder, BOARD)
    cache.write_cache(observations(spark, {"cam0": [9]}, "r2"), folder, BOARD)
    cache.write_cache(observations(spark, {"cam0": [5]}), folder, BOARD)  # again, without cam1
    found = {(r.recording, r.camera_id, r.connection_frame) for r in cache.cached_observations(spark, folder, BOARD).collect()}
    assert found == {("r1", "cam0", 5), ("r2", "cam0", 9)}
    broken = observations(spark, {"cam0": [77]}, "r3").withColumn("writing", F.lit("broke off"))
    broken.write.mode("append").partitionBy("recording", "camera_id").parquet(f"{folder}/observations")
    assert cache.cached_observations(spark, folder, BOARD).where("recording = 'r3'").count() == 0
    plan = cache.cached_observations(spark, folder, BOARD, cameras=["cam0"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cam0" in plan.split("PartitionFilters: [")[1].split("]")[0]


def scene(spark):
    rows = [("a", 1, "", "body", "nose", 1.5, 2.5, 3.5), ("a", 1, "", "body", "heel", None, 1.0, 1.0), ("a", 2, "", "body", "heel", -7.0, 0.0, 9.0), ("b", 1, "cam0", "body", "nose", 4.0, 5.0, 6.0), ("b", 1, "", "hand", "tip", 0.25, 0.5, 0.75)]
    points = spark.createDataFrame(rows, "recording string, frame long, camera_id string, tracker_id string, keypoint string, x double, y double, z double")
    names = spark.createDataFrame([("body", "nose", 0), ("body", "heel", 1), ("hand", "tip", 0), ("hand", "wrist", 1), ("hand", "thumb", 2)], "tracker_id string, keypoint string, ord int")
    return points, names


@pytest.mark.parametrize("embed", [False, True])
def test_messages_round_trip(spark, embed):
    points, names = scene(spark)
    messages = wire.encoded(wire.blocks(points, names, ["recording"]), ["recording"], embed)
    assert messages.count() == 3
    got = sorted((r.recording, r.frame, r.camera_id, r.tracker_id, r.ord, r.name, r.x, r.y, r.z, r.visibility) for r in wire.decoded(messages, ["recording"]).collect())
    name = lambda n: n if embed else None
    want = [
        ("a", 1, "", "body", 0, name("nose"), 1.5, 2.5, 3.5, 1.0), ("a", 1, "", "body", 1, name("heel"), None, None, None, 0.0),
        ("a", 2, "", "body", 0, name("nose"), None, None, None, 0.0), ("a", 2, "", "body", 1, name("heel"), -7.0, 0.0, 9.0, 1.0),
        ("b", 1, "", "hand", 0, name("tip"), 0.25, 0.5, 0.75, 1.0), ("b", 1, "", "hand", 1, name("wrist"), None, None, None, 0.0), ("b", 1, "", "hand", 2, name("thumb"), None, None, None, 0.0),
        ("b", 1, "cam0", "body", 0, name("nose"), 4.0, 5.0, 6.0, 1.0), ("b", 1, "cam0", "body", 1, name("heel"), None, None, None, 0.0),
    ]
    assert got == want


def test_bytes_of_a_message(spark):
    points, names = scene(spark)
    payload = wire.encoded(wire.blocks(points.where("recording = 'a' and frame = 1"), names, ["recording"]), ["recording"]).first().payload
    assert payload[:24] == struct.pack("<B7xqI4x", 3, 1, 1) and payload[-24:] == struct.pack("<B7xqI4x", 5, 1, 1)
    assert payload[24:84] == struct.pack("<BBBB16s32sII", 4, 0, 0, 3, b"", b"body", 2, 32)
    assert struct.unpack("<8f", payload[84:116])[:4] == (1.5, 2.5, 3.5, 1.0) and len(payload) == 140


def test_damaged_messages_are_errors(spark):
    points, names = scene(spark)
    good = wire.encoded(wire.blocks(points.where("recording = 'a' and frame = 1"), names, ["recording"]), ["recording"], True).first().payload
    wire._read(good)
    for bad in (b"", good[:30], good[:-1], good[1:], good[:24] + good[40:], good[:8] + b"\x09" + good[9:], good[:76] + b"\xff" + good[77:], good[:-24] + b"\0" + good[-24:]):
        with pytest.raises(ValueError):
            wire._read(bytes(bad))


def test_blocks_of_two_dimensions_and_doubles():
    head = struct.pack("<BBBB16s32sII", 4, 2, 1, 2, b"cam1", b"body", 1, 24) + struct.pack("<3d", 1.0, 2.0, 0.5)
    message = struct.pack("<B7xqI4x", 3, -4, 1) + head + struct.pack("<B7xqI4x", 5, -4, 1)
    frame, [(block, names, values)] = wire._read(message)
    assert frame == -4 and names is None and values.tolist() == [[1.0, 2.0, 0.5]] and block["camera_id"] == b"cam1"


def test_arrays_round_trip(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = [(c, f, p, float(f), float(p), None if p == 1 else 0.5) for c in ("cam0", "cam/1") for f in [*range(3, 40), *range(60, 75)] for p in range(3) if (f, p) != (10, 2)]
    df = spark.createDataFrame(rows, "camera_id string, frame long, point long, v0 double, v1 double, v2 double")
    npy.write_npy(df, path, 3, frames_per_task=16)
    got = npy.read_npy(spark, path, frames_per_task=7)
    assert got.rdd.getNumPartitions() > 8
    found = {tuple(r) for r in got.collect()}
    assert {r for r in found if r[3] is not None} == set(rows) and {r[:3] for r in found if r[3] is None} == {("cam0", 10, 2), ("cam/1", 10, 2)}
    npy.write_npy(df.where("camera_id = 'cam0' and frame < 5"), path, 3, mode="overwrite")
    assert {tuple(r) for r in npy.read_npy(spark, path).collect()} == {r for r in rows if r[0] == "cam0" and r[1] < 5}
    one = next(f for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs) if f.endswith(".npy"))
    assert np.load(one).shape == (2, 3, 3)


def test_files_of_short_ranges_do_not_overlap_and_share_tasks(spark, tmp_path):
    path, n = str(tmp_path / "arrays"), 6000
    df = spark.range(n).selectExpr("'c' as camera_id", "id + if(id < 3000, 0, 50000) as frame", "0L as point", "cast(id as double) as v0", "1.0D as v1", "2.0D as v2").repartition(8)
    npy.write_npy(df, path, 1, frames_per_task=10)
    shapes = [np.load(os.path.join(d, f)).shape for d, _, fs in os.walk(path) for f in fs if f.endswith(".npy")]
    assert sum(s[0] for s in shapes) == n and len(shapes) < 20  # no filled gap of 47,000 frames, no frame of another file's
    got = npy.read_npy(spark, path, frames_per_task=10)
    assert got.rdd.getNumPartitions() <= npy.TASKS
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}


def test_arrays_of_the_query_hold_every_point(spark, sf_dir):
    from motionloom.plans import demo, long_queries

    told = long_queries.array_round_trip(spark, sf_dir).groupBy("point").count().collect()
    n = demo.embeddings(spark, sf_dir).count()
    assert {r.point: r["count"] for r in told} == {k: n for k in range(demo.KEYPOINTS)}


def test_frames_of_nulls_and_frames_before_zero_come_back(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = [("c", f, p, None if f in (-3, 6) else float(f), None, None if f in (-3, 6) else 0.5) for f in (-5, -4, -3, 0, 6, 7) for p in range(2)]
    npy.write_npy(spark.createDataFrame(rows, npy.SCHEMA), path, 2)
    assert {tuple(r) for r in npy.read_npy(spark, path).collect()} == set(rows)


def test_files_of_scattered_frames_hold_only_these(spark, tmp_path):
    path, n = str(tmp_path / "arrays"), 900
    df = spark.range(n * 3).selectExpr("'c' as camera_id", "floor(id / 3) * if(id < 900, 10, 11) as frame", "id % 3 as point", "cast(id as double) as v0", "1.0D as v1", "2.0D as v2")
    df = df.where("frame > 0 or point = 1").localCheckpoint()
    npy.write_npy(df, path, 3)
    shapes = [np.load(os.path.join(d, f)).shape for d, _, fs in os.walk(path) for f in fs if f.endswith(".npy")]
    assert sum(s[0] for s in shapes) == n
    for step in (1, 7, 100_000):
        got = npy.read_npy(spark, path, frames_per_task=step)
        assert {tuple(r) for r in got.where("v0 is not null").collect()} == {tuple(r) for r in df.collect()}
        assert [tuple(r)[1:3] for r in got.where("v0 is null").orderBy("point").collect()] == [(0, 0), (0, 2)]


@pytest.mark.parametrize("held, batch", [(1, 1), (3, 1), (3, 2), (4, 5), (100, 7)])
def test_files_that_are_full_and_frames_over_two_batches(tmp_path, monkeypatch, held, batch):
    monkeypatch.setattr(npy, "FRAMES_A_FILE", held)
    frames = [0, 1, 2, 5, 6, 30, 60, 61, 62, 63, 90, 5000, 5001, 5002]
    rows = [(c, f, p, f + 0.5, None if f == 30 else float(p), None) for c in ("a", "b") for f in frames for p in range(2)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("camera_id", "frame", "point", "v0", "v1", "v2"), r)) for r in rows[at : at + batch]], pa.schema([("camera_id", pa.string()), ("frame", pa.int64()), ("point", pa.int64()), *((f"v{k}", pa.float64()) for k in range(3))])) for at in range(0, len(rows), batch)]
    options = {"path": str(tmp_path), "points": "2"}
    writer = npy.NpyWriter(options, False)
    writer.commit([writer.write(iter(batches))])
    shapes = [np.load(os.path.join(d, f)).shape[0] for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".npy")]
    assert max(shapes) <= 2 * held and sum(shapes) <= 2 * 2 * len(frames)
    reader = npy.NpyReader(options | {"framespertask": "3"})
    assert sorted((tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()), key=lambda r: r[:3]) == rows


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "arrays")
    df = spark.createDataFrame([("cam0", f, p, 1.0, 1.0, 1.0) for f in range(50) for p in (0, 1)] + [("cam0", 49, 9, 1.0, 1.0, 1.0)], "camera_id string, frame long, point long, v0 double, v1 double, v2 double")
    with pytest.raises(Exception, match="index 9|out of bounds|aborted|WRITING"):
        npy.write_npy(df, path, 2, frames_per_task=10)
    assert [f for _, _, files in os.walk(path) for f in files] == []


def test_recordings_stay_apart(spark):
    from motionloom.operators import align, stats
    from motionloom.sources import files
    from motionloom.streaming import frames as live

    points = spark.createDataFrame([("a", 1, "nose", 1.0, 2.0, 3.0), ("b", 1, "nose", 4.0, 5.0, 6.0), ("b", 1, "heel", None, 1.0, 1.0)], "recording string, frame long, keypoint string, x double, y double, z double")
    wide = {r.recording: r for r in files.long_to_wide(points, ["nose", "heel"], ("recording",)).collect()}
    assert wide["a"].nose_x == 1.0 and wide["b"].nose_x == 4.0 and wide["b"].heel_x is None
    blocks = {r.recording: np.frombuffer(r.payload, "<f4").reshape(2, 4) for r in files.wire_frames(points, ["nose", "heel"], ("recording",)).collect()}
    assert blocks["a"][0].tolist() == [1.0, 2.0, 3.0, 1.0] and blocks["b"][0].tolist() == [4.0, 5.0, 6.0, 1.0] and blocks["b"][1, 3] == 0
    com = points.where("keypoint = 'nose'").select("recording", "frame", "x", "y", "z")
    told = {r.recording: r.payload for r in files.payloads(points, com, ("recording",)).collect()}
    assert '"center_of_mass":{"x":4.0' in told["b"] and '"center_of_mass":{"x":1.0' in told["a"]
    latest = {r.recording: (r.frame, r.dropped) for r in live.latest_per_trigger(points.withColumn("frame", F.when(F.col("keypoint") == "heel", 9).otherwise(F.col("frame"))), ("recording",)).collect()}
    assert latest == {"a": (1, 0), "b": (9, 1)}
    obs = spark.createDataFrame([("a", 1, "c0"), ("b", 1, "c1"), ("b", 1, "c2")], "recording string, frame long, camera_id string")
    assert [tuple(r) for r in align.shared_counts(obs, by=("recording",)).collect()] == [("b", "c1", "c2", 1)]
    errors = spark.createDataFrame([(r, "c0", "c1", float(n)) for r in ("a", "b") for n in range(11 if r == "a" else 5)], "recording string, cam_a string, cam_b string, error double")
    assert [(r.recording, r.n) for r in stats.pair_percentiles(errors, by=("recording",)).collect()] == [("a", 11)]
