"""Recording folders: listing, bodies, counts, poses, schemas, bundles and the three places of a calibration."""

import tomllib

from pyspark.sql import functions as F

from motionloom.sources import recordings

TOML = """[cam_0]
name = "a"
size = [640, 480]
world_position = [1.0, 2.0, 3.0]
world_orientation = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
[cam_1]
name = "b"
size = [640, 480]
[metadata]
error = 0.5
"""


def folder(tmp_path):
    def put(name, text):
        path = tmp_path / "recordings" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("r1/videos/a.mp4", "xxxx")
    put("r1/videos/b.MP4", "xx")
    put("r1/output_data/other_body_3d_xyz.csv", "frame\n1\n")
    put("r1/output_data/z/mediapipe_body_3d_xyz.csv", "frame\n1\n")
    put("r1/timestamps/a.csv", "t\n1\n2\n3\n")
    put("r1/timestamps/b.csv", "t\n1\n2\n3\n\n")
    put("r1/r1_calibration.toml", TOML)
    put("r1/tracker_schema.json", recordings.schema_text("body", "mediapipe", ["nose", "ear"], [("nose", "ear")]))
    put("r2/videos/a.mp4", "x")
    put("r2/timestamps/a.csv", "t\n1\n")
    put("r2/timestamps/b.csv", "t\n1\n2\n")
    put("r2/output_data/b_body_3d_xyz.csv", "frame\n")
    put("r2/output_data/a_body_3d_xyz.csv", "frame\n")
    put("r2/calibration.toml", "not = [a toml")
    put("r2/tracker_schema.json", "{broken")
    put("r3/readme.txt", "nothing here")
    return str(tmp_path / "recordings")


def test_bundles(spark, tmp_path):
    root = folder(tmp_path)
    rows = recordings.bundles(spark, root).collect()
    assert [r.recording for r in rows] == ["r3", "r2", "r1"]
    r3, r2, r1 = rows
    assert (r1.n_files, r1.n_videos, r1.body_csv, r1.n_cameras, r1.n_frames, r1.in_sync, r1.posed_cameras, r1.tracker) == (8, 2, "output_data/z/mediapipe_body_3d_xyz.csv", 2, 3, True, ["a"], "body")
    assert (r2.n_videos, r2.body_csv, r2.n_frames, r2.in_sync, r2.posed_cameras, r2.tracker) == (1, "output_data/a_body_3d_xyz.csv", None, False, None, None)
    assert (r3.n_files, r3.n_videos, r3.body_csv, r3.n_cameras, r3.bytes) == (1, 0, None, None, 12)


def test_parts(spark, tmp_path):
    root = folder(tmp_path)
    counts = {(r.recording, r.camera_id): r.n_frames for r in recordings.frame_counts(spark, root).collect()}
    assert counts == {("r1", "a"): 3, ("r1", "b"): 3, ("r2", "a"): 1, ("r2", "b"): 2}
    [pose] = recordings.camera_poses(spark, root).collect()
    assert (pose.recording, pose.camera_id, pose.px, pose.py, pose.pz, pose.w11, pose.width) == ("r1", "a", 1.0, 2.0, 3.0, 1.0, 640)
    schemas = {r.recording: r for r in recordings.tracker_schemas(spark, root).collect()}
    assert schemas["r1"].connections == [["nose", "ear"]] and schemas["r2"].name == schemas["r3"].name == "fallback" and schemas["r3"].tracked_points == []
    old = spark.createDataFrame([("x/mediaPipeSkel_3d_body_hands_face.npy",), ("y/segmentCOM_frame_joint_xyz.npy",), ("total_body_center_of_mass_xyz.npy",), ("my_total_body_center_of_mass_xyz.npy",)], "file string").select(recordings.present_name(F.col("file")).alias("f"))
    assert [r.f for r in old.collect()] == ["x/mediapipe_skeleton_3d.npy", "y/mediapipe_segmentCOM_frame_joint_xyz.npy", "mediapipe_total_body_center_of_mass_xyz.npy", "my_total_body_center_of_mass_xyz.npy"]


def test_a_calibration_goes_to_three_places(spark, tmp_path):
    for text in (TOML, TOML.replace("0.5", "0.25")):  # the second replaces the first
        places = recordings.save_everywhere(spark, text, str(tmp_path / "rec"), str(tmp_path / "all"), "rec_calibration")
        assert len(places) == 3
        for place in places:
            with open(place, "rb") as file:
                assert tomllib.load(file) == tomllib.loads(text)
    assert len(list((tmp_path / "all").glob("*.toml"))) == 2 and not list((tmp_path / "all").glob("*.writing"))
