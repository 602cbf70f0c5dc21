"""Scenes with known answers: cameras, filters, rigid trees, balance, alignment, files, streams."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import camera as cam
from motionloom.functions import names
from motionloom.operators import align, calibration, gates, kinematics, stats, temporal, triangulate, windows
from motionloom.sources import files
from motionloom.streaming import frames as live

POINT = np.array([0.1, 0.2, 0.3])


def rig():
    """Four cameras in a square, looking at the origin: camera_id, rotation, translation."""
    found = {}
    for n, place in enumerate(([2, 0, 0.5], [0, 2, 0.5], [-2, 0, 0.5], [0, -2, 0.5])):
        place = np.array(place, float)
        z = -place / np.linalg.norm(place)
        x = np.cross([0, 0, -1.0], z)
        x /= np.linalg.norm(x)
        turn = np.vstack((x, np.cross(z, x), z))
        found[f"c{n}"] = (turn, -turn @ place)
    return found


def cameras(spark):
    rows = [(n, *turn.ravel().tolist(), *t.tolist()) for n, (turn, t) in rig().items()]
    return spark.createDataFrame(rows, "camera_id string, " + ", ".join(f"{c} double" for c in cam.EXTRINSICS))


def views(spark, bad=None, shift=0.5, hidden=()):
    rows = []
    for name, (turn, t) in rig().items():
        p = turn @ POINT + t
        uv = p[:2] / p[2] + (shift if name == bad else 0)
        rows.append((1, "nose", name, *(None if name in hidden else float(v) for v in uv)))
    return spark.createDataFrame(rows, "frame long, keypoint string, camera_id string, un double, vn double")


def position(row):
    return np.array([row.x, row.y, row.z])


@pytest.mark.parametrize("config", [None, triangulate.Rejection()])
@pytest.mark.parametrize("hidden", [(), ("c1",), ("c0", "c3")])
def test_exact_views_give_the_point(spark, config, hidden):
    (row,) = triangulate.triangulate(views(spark, hidden=hidden), cameras(spark), config).collect()
    assert np.abs(position(row) - POINT).max() < 1e-9 and row.n_cameras == 4 - len(hidden)


def test_ensemble_turns_away_from_a_corrupt_camera(spark):
    plain = triangulate.triangulate(views(spark, "c2"), cameras(spark)).first()
    ours = triangulate.triangulate(views(spark, "c2"), cameras(spark), triangulate.Rejection()).first()
    assert np.linalg.norm(position(ours) - POINT) < np.linalg.norm(position(plain) - POINT)
    assert min(ours.weights, key=ours.weights.get) == "c2"


def test_one_view_is_no_point(spark):
    assert triangulate.triangulate(views(spark, hidden=("c0", "c1", "c2")), cameras(spark)).count() == 0


def test_one_euro_follows_its_recurrence():
    f, x, dx, last = temporal.OneEuro(1.0, 0.5, 1.0), None, 0.0, None
    for n, v in enumerate([0.0, 1.0, 4.0, 3.0, 3.0]):
        t = n / 30
        got = f.step(t, np.array([v]))[0]
        if x is None:
            want = v
        else:
            a = lambda cutoff: (r := 2 * math.pi * cutoff * (t - last)) / (r + 1)  # noqa: E731, B023
            dx = a(1.0) * (v - x) / (t - last) + (1 - a(1.0)) * dx
            w = a(1.0 + 0.5 * abs(dx))
            want = w * v + (1 - w) * x
        assert got == pytest.approx(want, abs=1e-12)
        x, last = want, t
    with pytest.raises(ValueError):
        f.step(last, np.array([1.0]))


def test_lost_points_are_predicted_three_frames(spark):
    rows = [("a", n / 10, None if n in (3, 4, 5, 6) else float(n)) for n in range(9)]
    df = spark.createDataFrame(rows, "k string, t double, x double")
    got = temporal.predict_lost(df, ["k"], "t", ["x"]).orderBy("t").collect()
    assert [r.is_predicted for r in got] == [n in (3, 4, 5) for n in range(9)]
    assert got[6].x_out is None or math.isnan(got[6].x_out)
    steps = [got[n + 1].x_out - got[n].x_out for n in (2, 3, 4)]
    assert steps[1] == pytest.approx(steps[0] / 2) and steps[2] == pytest.approx(steps[1] / 2)


def test_velocity_gate_holds_and_gives_in_after_its_streak(spark):
    rows = [("a", n / 10, 0.0 if n == 0 else 100.0) for n in range(8)]
    df = spark.createDataFrame(rows, "k string, t double, x double")
    got = temporal.velocity_gate(df, ["k"], "t", ["x"], 10.0, streak=5).orderBy("t").collect()
    assert [r.is_held for r in got] == [False] + [True] * 5 + [False] * 2
    assert [r.x_out for r in got] == [0.0] * 6 + [100.0] * 2


def test_rigid_chain_has_exact_lengths_and_fills_gaps(spark):
    bones = [("mid", "tip", 80.0), ("root", "mid", 100.0)]
    rows = [(0, 1, "root", 0.0, 0.0, 0.0), (0, 1, "mid", 0.0, 90.0, 0.0), (0, 1, "tip", 0.0, 200.0, 0.0), (0, 2, "root", 5.0, 0.0, 0.0), (0, 2, "tip", 5.0, 150.0, 0.0), (0, 3, "mid", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "recording int, frame long, keypoint string, x double, y double, z double")
    got = {(r.frame, r.keypoint): position(r) for r in temporal.rigidify(df, bones, "root", ["recording"]).collect()}
    assert got[1, "mid"].tolist() == [0, 100, 0] and got[1, "tip"].tolist() == [0, 180, 0]
    assert got[2, "mid"].tolist() == [5, 100, 0] and got[2, "tip"].tolist() == [5, 180, 0]
    assert not any(frame == 3 for frame, _ in got)  # without its root a body is absent


def test_low_pass_keeps_slow_and_drops_fast():
    t = np.arange(300) / 30
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 13 * t)
    assert np.abs(temporal.low_pass(slow + fast, 30.0, 6.0) - slow)[20:-20].max() < 0.02
    assert temporal.low_pass(np.ones(50), 30.0, 6.0) == pytest.approx(np.ones(50))


def test_spline_and_line_fill_gaps(spark):
    rows = [("a", float(n), None if n in (0, 4, 5) else float(n * n)) for n in range(10)]
    df = spark.createDataFrame(rows, "k string, t double, x double")
    line = [r.x for r in windows.fill_linear(df, "k", "t", ["x"]).orderBy("t").collect()]
    assert line[0] == 1.0 and line[4] == pytest.approx(9 + 9) and line[5] == pytest.approx(9 + 18)
    spline = [r.x for r in temporal.spline_fill(df, ["k"], "t", ["x"]).orderBy("t").collect()]
    assert spline[0] == 1.0 and spline[4] == pytest.approx(16, abs=0.6) and spline[5] == pytest.approx(25, abs=0.6)


def test_two_masses_on_an_axis(spark):
    rows = [(0, 1.0, s, 0.0, 0.0, 0.0, 0.0, 0.0) for s in (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, mass double, x double, y double, z double, cx double, cy double, cz double")
    row = kinematics.principal_moments(kinematics.inertia(df)).first()
    assert (row.ixx, row.iyy, row.izz, row.ixy) == (0, 2, 2, 0)
    assert (row.i1, row.i2, row.i3) == pytest.approx((0, 2, 2), abs=1e-7)  # the closed form takes an acos at 1: half the digits


def test_sphere_has_equal_axes(spark):
    df = spark.createDataFrame([(3.0, 0.4 * 3 * 25, 0.4 * 3 * 25, 0.4 * 3 * 25)], "mass double, i1 double, i2 double, i3 double")
    row = kinematics.ellipsoid(df).first()
    assert (row.s1, row.s2, row.s3) == pytest.approx((5, 5, 5))


def test_mass_fractions_sum_to_one(spark):
    double = {"head": 1, "trunk": 1}
    for sex in ("mean", "female", "male"):
        rows = kinematics.inertial_parameters(spark, sex).collect()
        assert sum(r.mass * double.get(r.segment, 2) for r in rows) == pytest.approx(1, abs=2e-3)
    with pytest.raises(ValueError):
        kinematics.inertial_parameters(spark, "other")


def test_balance_points(spark):
    rows = [("a", 0.0, 0.0, 0.0, 1000.0), ("a", 1.0, 10.0, 0.0, 1000.0), ("a", 2.0, 10.0, 0.0, -1.0)]
    df = kinematics.xcom(spark.createDataFrame(rows, "k string, t double, x double, y double, z double"), "k", "t").orderBy("t")
    got = [r.xcom_x for r in df.collect()]
    assert got[0] is None and got[1] == pytest.approx(10 + 10 / math.sqrt(9.81)) and got[2] is None
    x, y = kinematics.cmp_xy(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    row = spark.createDataFrame([(30.0, 10.0, 900.0)], "x double, y double, z double").select(x.alias("cx"), y.alias("cy")).first()
    assert (row.cx, row.cy) == (30, 10)


def test_alignment_lists_missing_and_cached_frames(spark):
    rows = [(f, c) for f in range(4) for c in ("a", "b", "c") if (f, c) not in ((1, "b"), (3, "a"))]
    obs = spark.createDataFrame(rows, "frame long, camera_id string")
    assert {tuple(r) for r in align.missing(obs).collect()} == {(1, "b"), (3, "a")}
    assert {r.frame: r.complete for r in align.completeness(obs, 3).collect()} == {0: True, 1: False, 2: True, 3: False}
    frames = spark.createDataFrame([("c", i, 100 + i) for i in range(6)], "camera_id string, frame long, connection_frame long")
    cache = spark.createDataFrame([("c", 100), ("c", 102), ("c", 105), ("d", 101)], "camera_id string, connection_frame long")
    assert sorted(r.frame for r in align.cached(frames, cache).collect()) == [0, 2, 5]
    assert sorted(r.frame for r in align.uncached(frames, cache).collect()) == [1, 3, 4]


def test_gate_lets_points_without_error_pass(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 70.0, 1.0), (3, 60.0, 1.0)], "f int, mean_error double, x double").withColumns({"y": F.col("x"), "z": F.col("x")})
    assert [r.x for r in gates.reprojection(df).orderBy("f").collect()] == [1.0, None, 1.0]


def test_later_layers_win_where_they_have_a_point(spark):
    a = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0)], "frame long, keypoint string, x double")
    b = spark.createDataFrame([(1, "p", 5.0), (1, "q", None)], "frame long, keypoint string, x double")
    assert {r.keypoint: r.x for r in gates.merge(a, b).collect()} == {"p": 5.0, "q": 2.0}


def test_kabsch_finds_a_known_pose(spark):
    rng, turn, shift = np.random.default_rng(0), calibration.rodrigues(np.array([0.1, -0.4, 0.7])), np.array([120.0, -45.0, 8.0])
    a = rng.normal(size=(20, 3)) * 100
    rows = [(*p.tolist(), *(turn @ p + shift).tolist()) for p in a]
    row = calibration.kabsch_sums(spark.createDataFrame(rows, "x double, y double, z double, x2 double, y2 double, z2 double")).first()
    r, t = calibration.kabsch(row)
    assert np.abs(r - turn).max() < 1e-9 and np.abs(t - shift).max() < 1e-7
    with pytest.raises(ValueError):
        line = spark.createDataFrame([(float(n), 0.0, 0.0) * 2 for n in range(5)], "x double, y double, z double, x2 double, y2 double, z2 double")
        calibration.kabsch(calibration.kabsch_sums(line).first())


def test_rotations_round_trip_and_trees_hang_together():
    for v in ([0.1, 0.2, 0.3], [0, 0, 0], [3.0, 0.2, -0.3]):
        assert calibration.rotation_vector(calibration.rodrigues(np.array(v, float))) == pytest.approx(np.array(v), abs=1e-9)
    tree = calibration.spanning_tree([("a", "b", 5.0), ("b", "c", 3.0), ("a", "c", 4.0)])
    assert tree == [("a", "b", 5.0), ("a", "c", 4.0)]
    assert calibration.tree_pairs(tree, "b") == [("b", "a"), ("a", "c")]
    with pytest.raises(ValueError):
        calibration.spanning_tree([("a", "b", 1.0), ("c", "d", 1.0)])


def test_robust_average_ignores_outliers():
    rng = np.random.default_rng(1)
    vectors, shifts = rng.normal(0, 0.002, (40, 3)) + [0.2, 0.1, 0], rng.normal(0, 0.5, (40, 3)) + [10, 20, 30]
    vectors[:8], shifts[:8] = vectors[:8] + 1.0, shifts[:8] + 400
    turn, shift = calibration.average_transform(np.array([calibration.rodrigues(v) for v in vectors]), shifts)
    assert np.abs(shift - [10, 20, 30]).max() < 1.5 and np.abs(calibration.rotation_vector(turn) - [0.2, 0.1, 0]).max() < 0.01


def test_ground_faces_the_cameras():
    axes = calibration.ground_axes(np.diag([1.0, -1.0, -1.0]), np.zeros(3), np.array([[0.0, 0.0, 5.0]]))
    assert axes[:, 2].tolist() == [0, 0, 1] and np.linalg.det(axes) == pytest.approx(1)


def test_names(spark):
    rows = [("cam_01.mp4",), ("Camera3",), ("USB-cam.7",), ("video",)]
    df = spark.createDataFrame(rows, "s string").select("s", names.camera_index(F.col("s")).alias("n"))
    assert {r.s: r.n for r in df.collect()} == {"cam_01.mp4": 1, "Camera3": 3, "USB-cam.7": 7, "video": None}
    df = spark.createDataFrame([("body.nose.tip",)], "s string")
    assert df.select(names.strip_stage(F.col("s"))).first()[0] == "nose.tip"


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "long.csv").write_text("frame,keypoint,x,y,z\n0,nose,1,2,3\n1,nose,4,5,\n")
    (tmp_path / "wide.csv").write_text("frame,nose_x,nose_y,nose_z,ear_x,ear_y,ear_z\n0,1,2,3,4,5,6\n")
    assert files.body_csv(spark, str(tmp_path / "long.csv")).count() == 2
    assert {(r.keypoint, r.z) for r in files.body_csv(spark, str(tmp_path / "wide.csv")).collect()} == {("nose", 3.0), ("ear", 6.0)}
    head = "frame,keypoint,x,y,z,model,trajectory\n"
    (tmp_path / "strict.csv").write_text(head + "0,nose,1,2,3,m,3d_xyz\n0,face_1,1,2,3,m,3d_xyz\n1,nose,,,,m,3d_xyz\n")
    assert [r.keypoint for r in files.trajectory_csv(spark, str(tmp_path / "strict.csv")).collect()] == ["nose"]
    (tmp_path / "bad.csv").write_text(head + ",nose,1,2,3,m,3d_xyz\n")
    with pytest.raises(Exception, match="no frame"):
        files.trajectory_csv(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError):
        files.trajectory_csv(spark, str(tmp_path / "long.csv"))
    (tmp_path / "stamps.csv").write_text("n,timestamp.utc.seconds\n0,1.5\n1,2.5\n")
    assert [r.t for r in files.timestamps_csv(spark, str(tmp_path / "stamps.csv")).orderBy("row").collect()] == [1.5, 2.5]
    (tmp_path / "stats.json").write_text(json.dumps({"framerate_stats": {"median": 29.9}}))
    assert files.stats_json(spark, str(tmp_path / "stats.json")).first().median == 29.9


def test_calibration_and_npy_round_trip(spark, tmp_path):
    turn = calibration.rodrigues(np.array([0.3, -0.2, 0.1]))
    row = {"camera_id": "c0", "fx": 500.0, "fy": 501.0, "cx": 320.0, "cy": 240.0, "k1": 0.1, "k2": 0.0, "p1": 0.0, "p2": 0.01, "t0": 1.0, "t1": 2.0, "t2": 3.0, "width": 640, "height": 480}
    row |= {f"r{i}{j}": turn[i, j] for i in range(3) for j in range(3)}
    (tmp_path / "c.toml").write_text(files.calibration_text([row], {"board": "7x5"}))
    back = files.calibration_toml(spark, str(tmp_path / "c.toml")).first().asDict()
    assert back["camera_id"] == "c0" and all(back[k] == pytest.approx(row[k], abs=1e-9) for k in row if k != "camera_id")
    np.save(tmp_path / "w.npy", np.arange(24.0).reshape(2, 4, 3))
    assert sorted((r.frame, r.point, *r["values"]) for r in files.npy(spark, str(tmp_path / "w.npy")).collect())[-1] == (1, 3, 21.0, 22.0, 23.0)


def test_wire_frames_are_dense(spark):
    df = spark.createDataFrame([(1, "b", 1.0, 2.0, 3.0)], "frame long, keypoint string, x double, y double, z double")
    block = np.frombuffer(files.wire_frames(df, ["a", "b"]).first().payload, "<f4").reshape(2, 4)
    assert np.isnan(block[0, :3]).all() and block[0, 3] == 0 and block[1].tolist() == [1, 2, 3, 1]


def test_stable_run_and_shape_verdict(spark):
    motion = spark.createDataFrame([("a", n, 9.0 if n in (0, 6, 12) else 1.0) for n in range(25)], "k string, f int, motion double")
    row = windows.stable_runs(motion, "k", "f", 2.0, 10).first()
    assert (row.start, row.n_frames) == (13, 13)
    assert stats.in_sync(spark.createDataFrame([("r", 10), ("r", 11)], "r string, n int"), "r", "n").first().synchronized is False


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([(last,)], "ts timestamp").selectExpr("ts + interval 30 days as ts").crossJoin(events.drop("ts").limit(1)).select(*events.columns)
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    late.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all others
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = live.run_to_end(live.tumbling(stream, "1 hour", ("event_type",)), "tumbling_test")
    want = live.tumbling(events, "1 hour", ("event_type",))
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r["mean"], 9)) for r in df.collect())
    assert key(got) == key(want)


def test_filter_on_a_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 4")
    df = df.select(F.col("user_id").cast("string").alias("keypoint"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("ts").cast("timestamp").alias("ts"), "value")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    make = lambda: temporal.OneEuro(1e-7, 1e-9, 1e-6)
    got = live.run_to_end(live.filter_stream(stream, make, ["value"], "marked"), "filter_test")
    want = temporal.one_euro(df, ["keypoint"], "t", ["value"], min_cutoff=1e-7, beta=1e-9, d_cutoff=1e-6)
    key = lambda rows: sorted((r.keypoint, r.t, round(r.value_out, 6)) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 0


def test_a_rig_of_36_cameras_and_a_camera_listed_twice():
    """Sets of cameras are told apart whatever their numbers; the rule of the ensemble against a plain reading of it."""
    rng = np.random.default_rng(3)
    cameras = np.concatenate((np.linalg.qr(rng.normal(size=(4, 3, 3)))[0], rng.normal(size=(4, 3, 1)) + [[[0], [0], [6]]]), axis=2)
    points = rng.normal(size=(5, 3)) * 0.3
    seen = np.einsum("cij,pj->pci", cameras[:, :, :3], points) + cameras[:, :, 3]
    seen = seen[..., :2] / seen[..., 2:]
    seen[:, 2] += 0.2
    config = triangulate.Rejection()
    at, weights = triangulate.robust(seen, cameras, config, True)
    for p in range(5):
        best, found, used = None, [], []
        for k in (k for n in (4, 3, 2) for k in itertools.combinations(range(4), n)):
            x = triangulate.solve(seen[p : p + 1, k], cameras[list(k)])
            e = triangulate.errors(x, seen[p : p + 1, k], cameras[list(k)]).mean()
            found.append((e, x[0], [n in k for n in range(4)]))
        w = np.array([np.exp(-config.decay * (e - min(f[0] for f in found)) / config.target) for e, _, _ in found])
        want = sum(s * f[1] for s, f in zip(w / w.sum(), found, strict=True))
        assert at[p] == pytest.approx(want, abs=1e-9) and at[p] == pytest.approx(points[p], abs=1e-3)
        assert weights[p] == pytest.approx((w / w.sum()) @ np.array([f[2] for f in found]), abs=1e-9) and weights[p].argmin() == 2


def test_spline_is_not_a_knot(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.5, 2, 40))
    cubic = 2 - t + 0.3 * t**2 - 0.01 * t**3  # such a spline holds any cubic as it is
    rows = [("k", float(a), None if n in (1, 2, 7, 20, 37, 38) else float(b)) for n, (a, b) in enumerate(zip(t, cubic, strict=True))]
    got = temporal.spline_fill(spark.createDataFrame(rows, "k string, t double, x double"), ["k"], "t", ["x"]).orderBy("t").collect()
    assert [r.x for r in got] == pytest.approx(cubic.tolist(), rel=1e-9)
    assert temporal.curvatures(np.array([1.0, 2.0]), np.array([1.0, 4.0])).tolist() == pytest.approx([2.0] * 3)  # x^2 at 0, 1, 3


def test_frames_out_of_order_pass_and_gaps_break_runs(spark):
    step = temporal.Predicting().step
    assert step(1.0, np.array([5.0]))[0] == 5 and step(0.5, np.array([9.0]))[0] == 9 and step(0.7, np.array([np.nan]))[0] is None
    rows = [(rec, f, c, 0.01 * f, 0.0, 0.0) for rec in ("a", "b") for f in [*range(8), *range(20, 28)] for c in range(4)]
    corners = spark.createDataFrame(rows, "rec string, frame int, corner_id int, x double, y double, z double")
    motion = windows.board_motion(corners, 3, ("rec",))
    assert {r.frame for r in motion.where("motion > 1e9").collect()} == {7} and motion.count() == 30
    assert {(r.rec, r.start, r.n_frames) for r in windows.stable_runs(motion, "rec", "frame", 1.0, 5).collect()} == {("a", 0, 8), ("b", 0, 8)}


def test_ground_plane_of_a_lying_board(spark):
    turn = calibration.rodrigues(np.array([0.09, 0.12, 0.2]))
    board = [(k, 40.0 * (k % 5), 40.0 * (k // 5)) for k in range(20)]
    rows = [(rec, f, k, *(turn @ [bx, by, 0.0] + [120.0, -45.0, 8.0] + (0.0 if f >= 10 else 30.0 * f)).tolist()) for rec in (1, 2) for f in range(40) for k, bx, by in board]
    corners = spark.createDataFrame(rows, "rec int, frame int, corner_id int, x double, y double, z double")
    found = calibration.ground_plane(corners, spark.createDataFrame(board, "corner_id int, bx double, by double"), np.array([[0.0, 0.0, 900.0]]), "rec", 1.0, 10).collect()
    assert {r.rec for r in found} == {1, 2}
    for r in found:
        assert [r.ox, r.oy, r.oz] == pytest.approx([120, -45, 8], abs=1e-6)
        assert [r[f"g{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(turn.ravel().tolist(), abs=1e-9)


def test_two_recordings_stay_apart(spark):
    rows = [(rec, 0, k, float(n * s), 0.0, 0.0) for s, rec in ((1, "a"), (3, "b")) for n, k in enumerate(("p", "q"))]
    points = spark.createDataFrame(rows, "rec string, frame int, keypoint string, x double, y double, z double")
    segments = spark.createDataFrame([("s", "s", "p", "q")], "segment string, pair string, proximal string, distal string")
    assert {(r.rec, r.length) for r in stats.segment_lengths(points, segments, ("rec", "frame")).collect()} == {("a", 1.0), ("b", 3.0)}
    obs = spark.createDataFrame([("a", 0, "c1"), ("b", 0, "c1"), ("b", 0, "c2"), ("b", 1, "c1")], "rec string, frame int, camera_id string")
    assert {(r.rec, r.frame, r.complete) for r in align.completeness(obs, 2, ("rec", "frame")).collect()} == {("a", 0, False), ("b", 0, True), ("b", 1, False)}
    assert [(r.rec, r.frame, r.camera_id) for r in align.missing(obs, ("rec",)).collect()] == [("b", 1, "c2")]
    with pytest.raises(ValueError):
        kinematics.xcom(points, None, "frame")
