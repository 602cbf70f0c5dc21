"""Block forms against the whole: as-of joins, epochs, rigid skeletons, splines and filters; boards and rigs against known ones."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.operators import adjust, asof, boards, epochs, rigid, robust, series, stats, temporal


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# As-of joins

def plain_asof(left, right, tolerance, direction):
    out = []
    for k, t, n in left:
        best = None
        for k2, t2, v in right:
            if k2 != k or t is None or t2 is None:
                continue
            gap = t - t2 if direction == "backward" else t2 - t if direction == "forward" else abs(t - t2)
            if gap >= 0 and (tolerance is None or gap <= tolerance):
                key = (gap, t2 > t, -v)
                best = min(best, (key, t2, v)) if best else (key, t2, v)
        out.append((k, t, n, best and best[1], best and best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 2.5])
def test_asof_join(spark, direction, tolerance):
    rng = np.random.default_rng(3)
    left = [(int(k), float(t), n) for n, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 80, 60) / 2, strict=True))] + [(0, None, 99), (7, 1.0, 100)]
    right = [(int(k), float(t), int(v)) for k, t, v in zip(rng.integers(0, 3, 40), rng.integers(10, 60, 40) / 2, rng.integers(0, 9, 40), strict=True)] + [(1, None, 5)]
    df = asof.asof(table(spark, left, "k int, t double, n int"), table(spark, right, "k int, t double, v int"), ["k"], "t", ["v"], 3.0, tolerance, direction)
    assert df.columns == ["k", "t", "n", "t_found", "v"]
    assert sorted(map(tuple, df.collect()), key=repr) == plain_asof(left, right, tolerance, direction)


def test_a_hot_camera_is_spread_over_blocks(spark):
    """A third of all rows has one key: no window is over a whole key, and the blocks' windows take few rows each."""
    n = 6000
    times = spark.range(3 * n).select((F.col("id") % 3 * F.col("id") % 50).alias("k"), (F.col("id") / 3.0).alias("t"))
    shown = times.withColumn("frame", F.floor(F.col("t") * 2).cast("long"))
    df = asof.frames_at(times, shown, ["k"], 10.0, 100.0)
    assert df.where("frame is null or frame <> floor(t * 2)").count() == 0 and df.count() == 3 * n


# Epochs

def test_epochs_equal_the_state_in_order(spark):
    rng = np.random.default_rng(5)
    frames = [(r, n, n * 0.1, None if rng.random() < 0.1 else bool(rng.random() < (0.9 if (n // 70) % 2 else 0.15))) for r in (0, 1) for n in range(400)]
    frames += [(2, n, n * 0.1, False) for n in range(60)] + [(3, 0, 0.0, True)]
    versions = [(0, 3.05, "a"), (0, 21.0, "b"), (1, -1.0, "x"), (2, 0.0, "c"), (2, 2.05, "d")]
    df = epochs.epochs(table(spark, frames, "recording int, frame int, t double, ok boolean"), table(spark, versions, "recording int, t double, version string"), ["recording"], 0.75)
    want = []
    for r in range(4):
        state = epochs.Calibration()
        events = sorted([(t, 0, v, None, None) for k, t, v in versions if k == r] + [(t, 1, None, n, ok) for k, n, t, ok in frames if k == r], key=lambda e: e[:2])
        for t, kind, v, n, ok in events:
            if kind == 0:
                state.load(t, v)
            else:
                version, since, failures, status = state.frame(ok)
                want.append((r, n, t, ok, version, since, None if since is None else failures, status))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert {w[-1] for w in want} == {"none", "valid", "invalid"}


# Rigid skeletons

BONES = [("a", "b", 10.0), ("b", "c", 8.0), ("c", "d", 3.0), ("a", "e", 5.0), ("e", "f", 0.0), ("f", "g", 4.0), ("c", "h", 2.0)]


def walk(n, seed, lost):
    rng = np.random.default_rng(seed)
    at = {k: rng.normal(0, 20, 3) for k in "abcdefgh"}
    rows = []
    for f in range(n):
        for k in at:
            at[k] = at[k] + rng.normal(0, 1, 3)
            if rng.random() > lost:
                rows.append((seed, f, k, *map(float, at[k])))
    return rows


@pytest.mark.parametrize("size", [1, 7, 64])
def test_rigid_blocks_equal_the_serial_step(spark, size):
    rows = walk(150, 1, 0.6) + walk(40, 2, 0.93) + [(3, f, k, 1.0, 1.0, 1.0) for f in range(30) for k in "abc"]
    rows += [(4, f, "a", 0.0, 0.0, float(f)) for f in range(30)] + [(4, 3, "b", 0.0, 0.0, 9.0), (4, 20, "c", 5.0, 0.0, 0.0), (4, 21, "d", None, 0.0, 0.0)]
    points = table(spark, rows, "recording int, frame int, keypoint string, x double, y double, z double")
    key = lambda r: (r.recording, r.frame, r.keypoint, round(r.x, 9), round(r.y, 9), round(r.z, 9))
    want = sorted(map(key, temporal.rigidify(points, BONES, "a", ["recording"]).collect()))
    assert sorted(map(key, rigid.rigid_blocks(points, BONES, "a", ["recording"], block_frames=size).collect())) == want


def test_the_registered_skeleton_is_dealt_in_blocks(spark, sf_dir):
    """One recording of all frames is no single group, and is what the plain form gives."""
    from motionloom.plans import demo, queries

    df = queries.rigid_skeleton(spark, sf_dir)
    assert "_b#" in plan(df)
    points = demo.points(spark, sf_dir).withColumn("recording", F.lit(0))
    assert set(df.collect()) == set(queries.rounded(temporal.rigidify(points, queries.BONES, "12", ["recording"]), 4).collect())


def test_blocks_hand_on_few_frames():
    rows = {}
    for _, f, k, *p in walk(3000, 9, 0.3):
        rows.setdefault(f, {})[k] = np.array(p)
    decide = rigid._needed([(rows[f], {}) for f in sorted(rows)], temporal.tree_order(BONES, "a"), "a")
    assert len(decide) < 60


def test_lengths_are_learnt_from_measured_points_alone(spark):
    rows = [(0, f, f * 0.5, k, 0.0, 0.0, z, p) for f in range(80) for k, z, p in (("a", 0.0, False), ("b", 10.0 + f % 5, f % 3 == 0), ("c", 0.0 if f < 30 else None, None))]
    points = table(spark, rows, "recording int, frame int, t double, keypoint string, x double, y double, z double, is_predicted boolean").withColumn("x", F.when(F.col("z").isNotNull(), F.col("x")))
    bones = table(spark, [("a", "b", 7.0), ("b", "c", 6.0)], "parent string, child string, seed double")
    got = {(r.frame, r.child): r.length for r in rigid.measured_lengths(points, bones, ["recording"], 3.0, 4.0).collect()}
    for f in range(80):
        own = [10.0 + g % 5 for g in range(max(0, f - 6), f + 1) if g % 3]
        low = [10.0 + g % 5 for g in range(max(0, f - 6), f + 1) if g % 3 and g < 30]
        assert got[f, "b"] == (np.median(own) if own else 7.0)
        assert got[f, "c"] == (np.median(low) if low else 6.0)


# Streams

def test_slices_of_many_files_come_in_order_and_recordings_share_states(spark, monkeypatch):
    """Each slice has the same number of files, an empty one too; a state serves 64 recordings, and each is told as alone."""
    from motionloom.streaming import epochs as live
    from motionloom.streaming import pending, replay

    assert replay.RECORDINGS_A_STATE == 64
    monkeypatch.setattr(replay, "ROWS_A_FILE", 100)
    rng, rows, events = np.random.default_rng(8), [], []
    for n in range(1500):
        t = float(n if n < 1000 else n + 3000)  # the middle slice is empty
        recording = int(rng.integers(-3, 100))
        load = rng.random() < 0.05
        ok = None if load or rng.random() < 0.1 else bool(rng.random() < 0.3)
        rows.append((recording, "load" if load else "frame", None if load else n, t, ok, f"v{n}" if load else None))
        events.append((recording, "camera" if rng.random() < 0.5 else "result", int(n // 200), t, float(n)))
    stamped = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    stream = replay.replayed(stamped(table(spark, rows, "recording long, kind string, frame long, t double, ok boolean, version string")), "ts", 3)
    got = {r.frame: (r.recording, r.version, r.failures, r.status) for r in replay.played(live.epoch_stream(stream), spark).collect()}
    held, want = {}, {}
    for recording, kind, frame, t, ok, version in rows:
        mine = held.setdefault(recording, epochs.Calibration())
        if kind == "load":
            mine.load(t, version)
        else:
            version, since, failures, status = mine.frame(ok)
            want[frame] = (recording, version, None if since is None else failures, status)
    assert got == want
    one, alone, expected = replay.replayed(stamped(table(spark, events, "recording long, kind string, frame long, t double, value double")).drop("t"), "ts", 3, replay.stateful_session(spark)), {}, []
    for recording, kind, frame, t, value in events:
        mine, micros = alone.setdefault(recording, pending.Pending(400 * 10**6)), int(t * 1e6)
        expected += [(recording, *x) for x in (mine.camera(frame, micros) if kind == "camera" else mine.result(frame, micros, value))]
    end = int(events[-1][3] * 1e6)
    expected += [(recording, *x) for recording, mine in alone.items() for x in mine.passed(end)]
    told = replay.played(pending.pending_frames(one, 400.0), spark).selectExpr("recording", "frame", "unix_micros(ts)", "result", "status").collect()
    assert sorted(map(str, map(tuple, told))) == sorted(map(str, expected))


# Splines and filters

def test_spline_blocks_equal_the_whole_series(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.2, 2.0, 3000))
    y = np.sin(t / 7) * 100 + rng.normal(0, 5, len(t))
    y[rng.random(len(t)) < 0.4] = np.nan
    y[500:1100], y[:5], y[-9:] = np.nan, np.nan, np.nan  # a gap over many blocks, and open ends
    rows = [(0, float(a), None if np.isnan(b) else float(b)) for a, b in zip(t, y, strict=True)] + [(1, 5.0, None), (1, 6.0, 2.0), (2, 1.0, None), (0, None, None)]
    df = table(spark, rows, "k int, t double, y double")
    for order in (0, 1, 3):
        got = {(r.k, r.t): r.y for r in series.fill_blocks(df, ["k"], "t", ["y"], 40.0, order).collect()}
        ok = ~np.isnan(y)
        want = np.where(ok, y, series.interpolate(t, t[ok], y[ok], order))
        assert np.allclose([got[0, float(a)] for a in t], want, rtol=1e-11, atol=1e-9)
        assert got[1, 5.0] == (2.0 if order else 2.0) and got[2, 1.0] is None and got[0, None] is None and len(got) == len(rows)
    with pytest.raises(ValueError):
        series.interpolate(t, t, y, 2)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_many_short_series_share_batches(spark, small_batches):
    """No group of pandas a series; series that go over the ends of batches, or fill several, are the same."""
    rng = np.random.default_rng(5)
    rows, want = [(None, 1.0, None), (None, 2.0, 4.0)], {(None, 1.0): 4.0, (None, 2.0): 4.0}
    for k in range(60):
        t = np.cumsum(rng.uniform(0.5, 2.0, int(rng.integers(1, 40))))
        y = np.where(rng.random(len(t)) < 0.4, np.nan, rng.normal(0, 9, len(t)))
        rows += [(k, float(a), None if np.isnan(b) else float(b)) for a, b in zip(t, y, strict=True)]
        ok = ~np.isnan(y)
        want |= {(k, float(a)): b for a, b in zip(t, np.where(ok, y, series.interpolate(t, t[ok], y[ok], 3)), strict=True)}
    filled = series.fill_blocks(table(spark, rows, "k int, t double, y double"), ["k"], "t", ["y"], 9.0)
    assert "InPandas" not in plan(filled)
    got = {(r.k, r.t): np.nan if r.y is None else r.y for r in filled.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-11, atol=1e-9, equal_nan=True)


def test_many_short_keys_of_a_filter_share_batches(spark, small_batches):
    rng, rows, want = np.random.default_rng(6), [], {}
    for k in range(80):
        gate = temporal.VelocityGate(3.0)
        for n in range(int(rng.integers(1, 25))):
            x = None if rng.random() < 0.2 else float(rng.normal(0, 4))
            rows.append((k, float(n), x))
            value, held = gate.step(float(n), np.array([np.nan if x is None else x]))
            want[k, float(n)] = (None if np.isnan(value[0]) else value[0], held)
    gated = temporal.velocity_gate(table(spark, rows, "k int, t double, x double"), ["k"], "t", ["x"], 3.0)
    assert "InPandas" not in plan(gated) and {(r.k, r.t): (r.x_out, r.is_held) for r in gated.collect()} == want


def test_filter_blocks_equal_the_whole_series(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(0, 1, 5000))
    df = table(spark, [(0, n, float(v)) for n, v in enumerate(x)] + [(1, n, float(v)) for n, v in enumerate(x[:40])] + [(2, 0, 1.0)], "k int, n int, y double")
    got = {(r.k, r.n): r.y for r in series.smooth_blocks(df, ["k"], "n", ["y"], 30.0, 6.0, block_samples=600).collect()}
    assert np.allclose([got[0, n] for n in range(5000)], temporal.low_pass(x, 30.0, 6.0), rtol=0, atol=1e-9)
    assert np.allclose([got[1, n] for n in range(40)], temporal.low_pass(x[:40], 30.0, 6.0), rtol=0, atol=1e-9) and got[2, 0] == 1.0


def test_low_pass_is_the_recursive_filter_forth_and_back():
    """Against the difference equation of the bilinear transform, run forwards and backwards in the middle of a long series."""
    rate, cutoff, n = 30.0, 6.0, 2000
    x = np.random.default_rng(1).normal(0, 1, n)
    warped = 2 * rate * math.tan(math.pi * cutoff / rate)
    y = x.copy()
    for _ in range(2):
        for k in range(2):  # order four: two sections
            q = 2 * math.cos(math.pi * (2 * k + 1) / 8)
            c = 2 * rate
            a0, a1, a2 = c * c + q * warped * c + warped**2, 2 * (warped**2 - c * c), c * c - q * warped * c + warped**2
            out = np.zeros(n)
            for i in range(2, n):
                out[i] = (warped**2 * (y[i] + 2 * y[i - 1] + y[i - 2]) - a1 * out[i - 1] - a2 * out[i - 2]) / a0
            y = out
        y = y[::-1]
    assert np.allclose(temporal.low_pass(x, rate, cutoff)[300:-300], y[300:-300], atol=1e-9)


def test_gaps_are_filled_before_the_filter(spark):
    x = np.sin(np.arange(300) / 9.0)
    df = table(spark, [(0, n, None if n % 7 == 3 else float(v)) for n, v in enumerate(x)], "k int, n int, y double")
    got = [r.y for r in series.fill_and_smooth(df, ["k"], "n", ["y"], 30.0, 6.0, 50.0, block_samples=100).orderBy("n").collect()]
    assert np.abs(np.array(got) - x).max() < 2e-2


def test_nulls_leave_filters_as_they_are():
    nan = np.array([np.nan])
    gate, euro, plain = temporal.VelocityGate(5.0), temporal.OneEuro(), temporal.OneEuro()
    assert np.isnan(gate.step(0.0, nan)[0]).all() and gate.step(1.0, np.array([1.0])) == (1.0, False)
    assert np.isnan(gate.step(2.0, nan)[0]).all() and gate.step(3.0, np.array([2.0])) == (2.0, False) and gate.rejected == 0
    for n in range(6):
        got = euro.step(float(n), nan if n in (0, 3) else np.array([float(n)]))
        assert np.isnan(got).all() == (n in (0, 3))
        if n not in (0, 3):
            assert got == plain.step(float(n), np.array([float(n)]))


# Boards and rigs

BOARD = [(n, (n % 7) * 40.0, (n // 7) * 40.0) for n in range(35)]


def projected(turn, shift, c, xy):
    p = np.column_stack((xy, np.zeros(len(xy)))) @ turn.T + shift
    a, b = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
    r2 = a * a + b * b
    rad = 1 + c[4] * r2 + c[5] * r2 * r2
    return np.column_stack((c[0] * (a * rad + 2 * c[6] * a * b + c[7] * (r2 + 2 * a * a)) + c[2], c[1] * (b * rad + c[6] * (r2 + 2 * b * b) + 2 * c[7] * a * b) + c[3]))


def views(spark, n, cameras, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    xy = np.array([(x, y) for _, x, y in BOARD])
    truth, rows = {}, []
    for v in range(n):
        turn = boards.turned(rng.normal(0, 0.35, (1, 3)))[0]
        shift = np.array([rng.normal(-100, 60), rng.normal(-60, 60), rng.uniform(700, 1500)])
        name = sorted(cameras)[v % len(cameras)]
        uv = projected(turn, shift, cameras[name], xy) + rng.normal(0, noise, xy.shape) if noise else projected(turn, shift, cameras[name], xy)
        truth[name, v] = (turn, shift)
        keep = rng.permutation(35)[: 35 - v % 9]
        rows += [(name, v, int(i), float(uv[i, 0]), float(uv[i, 1])) for i in keep]
    rows += [("cam0", 1000, i, 5.0 * i, 1.0) for i in range(5)]  # too few corners
    return truth, table(spark, rows, "camera_id string, frame int, corner_id int, u double, v double")


CAMS = {"cam0": (900.0, 910.0, 640.0, 360.0, 0.05, -0.01, 0.001, -0.0005), "cam1": (1200.0, 1190.0, 600.0, 400.0, -0.1, 0.02, 0.0, 0.001)}


def rigs(spark, cams=CAMS):
    return table(spark, [(k, *v) for k, v in cams.items()], "camera_id string, fx double, fy double, cx double, cy double, k1 double, k2 double, p1 double, p2 double")


@pytest.mark.parametrize("noise, bound", [(0.0, 1e-9), (0.3, 6.0)])
def test_board_poses(spark, noise, bound):
    truth, df = views(spark, 40, CAMS, noise)
    board = table(spark, BOARD, "corner_id int, bx double, by double")
    got = boards.board_poses(boards.views_of(df, board, ["camera_id", "frame"]), rigs(spark), ["camera_id", "frame"]).collect()
    assert len(got) == 40
    for r in got:
        turn, shift = truth[r.camera_id, r.frame]
        assert np.abs(np.array([r[c] for c in boards.POSE[9:]]) - shift).max() < max(bound, 1e-8)
        assert np.abs(np.array([r[c] for c in boards.POSE[:9]]).reshape(3, 3) - turn).max() < max(bound / 100, 1e-10)
        assert r.rms < (1e-9 if not noise else 0.6)


def test_intrinsics_from_boards(spark):
    plain = {k: (*v[:4], 0.0, 0.0, 0.0, 0.0) for k, v in CAMS.items()}
    _, df = views(spark, 60, plain)
    board = table(spark, BOARD, "corner_id int, bx double, by double")
    found = boards.board_homographies(boards.views_of(df, board, ["camera_id", "frame"]), ["camera_id", "frame"])
    got = {r.camera_id: r for r in boards.intrinsics(boards.intrinsic_sums(found, ["camera_id"]), ["camera_id"]).collect()}
    for k, v in plain.items():
        assert np.allclose([got[k].fx, got[k].fy, got[k].cx, got[k].cy], v[:4], rtol=1e-6) and got[k].n_views == 30
    one = boards.intrinsics(boards.intrinsic_sums(found.where("frame = 0"), ["camera_id"]), ["camera_id"]).first()
    assert one.n_views == 1 and one.fx is None


def test_views_stay_in_arrays(spark, monkeypatch):
    """A batch of frames is taken apart in slices of bounded size; slices of any size give the same views."""
    import pyarrow as pa

    number, rng = {"a": 0, "b": 1}, np.random.default_rng(3)
    frames = [[{"corner_id": c, "camera_id": k, "u": rng.normal(), "v": rng.normal(), "_bx": 1.0 * c, "_by": 2.0 * c} for c in range(3 + n % 3) for k in "ab"] for n in range(23)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(23)), pa.array(frames)], ["frame", "views"])
    for size in (1, 7, 500):
        monkeypatch.setattr(adjust, "FRAMES_AT_ONCE", size)
        got = []
        for part, flat, (corner, cam, uv, board), bounds in adjust._views(batch.slice(2), number):
            assert len(part) == len(bounds) <= size and len(flat) == len(cam)
            got += [list(zip(corner[i:j].tolist(), cam[i:j].tolist(), uv[i:j].tolist(), board[i:j].tolist(), strict=True)) for i, j in bounds]
        assert got == [[(v["corner_id"], number[v["camera_id"]], [v["u"], v["v"]], [v["_bx"], v["_by"], 0.0]) for v in views] for views in frames[2:]]


def test_bundle_adjustment_finds_the_rig(spark):
    rng = np.random.default_rng(0)
    names = ("a", "b", "c", "d")
    turns, shifts = [], []
    for k in range(4):
        pos = np.array([3000 * math.cos(k * math.pi / 2), 3000 * math.sin(k * math.pi / 2), 1500])
        z = -pos / np.linalg.norm(pos)
        x = np.cross(z, [0, 0, 1.0])
        x /= np.linalg.norm(x)
        turn = np.stack((x, np.cross(z, x), z))
        turns.append(turn)
        shifts.append(-turn @ pos)
    true = adjust.Rig(names, np.array(turns), np.array(shifts), np.array([900.0, 950, 1000, 880]), np.array([0.02, -0.01, 0.03, 0]), np.tile([640.0, 360], (4, 1)))
    off = np.concatenate([np.r_[rng.normal(0, 0.003, 3), rng.normal(0, 4, 3), rng.normal(0, 3), rng.normal(0, 0.003)] for _ in names])
    off[:6] = 0
    places = np.array([(x, y, 0.0) for _, x, y in BOARD])
    rows = []
    for f in range(60):
        points = places @ boards.turned(rng.normal(0, 0.8, (1, 3)))[0].T + rng.normal(0, 300, 3)
        for c, name in enumerate(names):
            if rng.random() < 0.8:
                uv = true.pixels(np.full(35, c), points) + rng.normal(0, 0.01, (35, 2))
                uv[0] += 400 * (f % 10 == 0)  # a corner taken for another
                rows += [("r", f, name, i, *map(float, uv[i])) for i in range(35)]
    df = table(spark, rows, "recording string, frame int, camera_id string, corner_id int, u double, v double")
    board = table(spark, BOARD, "corner_id int, bx double, by double")
    found, told = adjust.adjust(df, board, true.moved(off), ["recording", "frame"], 2 / 40, rounds=4, steps=2, enough=0.001)
    assert told[0]["median"] > 1 and told[-1]["median"] < 0.05
    assert np.abs(found.focal - true.focal).max() < 0.5 and np.abs(found.k1 - true.k1).max() < 1e-3
    assert np.abs(found.shift - true.shift).max() < 1.5 and np.abs(found.turn - true.turn).max() < 1e-3
    assert np.array_equal(found.turn[0], true.turn[0]) and np.array_equal(found.shift[0], true.shift[0])


def _rig_scene(n_frames, seed, noise):
    """A rig, the views of frames (camera, corner, pixels, board's places, frame; all in order) and a step of all unknowns."""
    rng = np.random.default_rng(seed)
    turns = np.array([boards.turned(np.array([[0.0, k * 0.4 - 0.6, 0.1 * k]]))[0] for k in range(4)])
    rig = adjust.Rig(tuple("abcd"), turns, np.array([[100.0 * k, -20.0, 2600.0 + 50 * k] for k in range(4)]), np.array([900.0, 950, 1000, 880]), np.array([0.02, -0.01, 0.03, 0]), np.tile([640.0, 360], (4, 1)))
    views = []
    for f in range(n_frames):
        some = np.sort(rng.permutation(35)[: rng.integers(3, 36)])
        places = np.array([(x, y, 0.0) for _, x, y in BOARD])[some]
        points = places @ boards.turned(rng.normal(0, 0.4, (1, 3)))[0].T + rng.normal(0, 100, 3)
        for i, (corner, place) in enumerate(zip(some, places, strict=True)):
            for cam in np.sort(rng.permutation(4)[: rng.integers(2, 5)]):
                views.append((corner, cam, *(rig.pixels(np.array([cam]), points[i : i + 1])[0] + rng.normal(0, noise, 2)), *place, f))
    v = np.array(views)
    return rig, (v[:, 0].astype(int), v[:, 1].astype(int), v[:, 2:4], v[:, 4:7], v[:, 7].astype(int)), np.tile([0.002, -0.001, 0.001, 2, -3, 2, 3, 0.002], 4)


def test_frames_are_solved_side_by_side():
    """Frames together give the sums of frames one by one, many times faster; the slope is that of the cost; a frame that has a
    point behind a camera, or no number, takes nothing from the others."""
    rig, views, step = _rig_scene(120, 2, 0.5)
    rig = rig.moved(step)
    start = time.perf_counter()
    whole, slope, cost, n = adjust.Frames.of(*views).reduced(rig, 0.05, 2.0)
    together, start = time.perf_counter() - start, time.perf_counter()
    each = [adjust.Frames.of(*(v[views[4] == f] for v in views)).reduced(rig, 0.05, 2.0) for f in range(120)]
    assert n == 120 and time.perf_counter() - start > 5 * together
    for k, got in enumerate((whole, slope, cost, n)):
        want = sum(e[k] for e in each)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    assert np.allclose(whole, whole.T) and np.linalg.eigvalsh(whole).min() > -1e-6 * np.abs(whole).max()
    for k, h in ((8, 1e-6), (12, 1e-3), (14, 1e-3), (15, 1e-6), (25, 1e-6), (31, 1e-6)):  # unknowns of several cameras
        ends = [adjust.Frames.of(*views).solved(rig.moved(np.eye(32)[k] * d), 0.05, 50.0, rounds=8)[2].sum() for d in (h, -h)]
        at = adjust.Frames.of(*views).reduced(rig, 0.05, 50.0)[1][k]
        assert abs((ends[0] - ends[1]) / (4 * h) - at) < 1e-3 * abs(at) + 1e-3
    bad = tuple(v.copy() for v in views)
    bad[2][np.flatnonzero(views[4] == 7)[0]] = np.nan
    with np.errstate(all="ignore"):
        got = adjust.Frames.of(*bad).reduced(rig, 0.05, 2.0)
    assert got[3] == 119 and np.isclose(got[2], cost - each[7][2]) and np.allclose(got[0], whole - each[7][0], atol=1e-9 * np.abs(whole).max())


def test_points_of_all_views():
    """Triangulated points are the last directions of their equations, also where two directions are alike."""
    rig, views, _ = _rig_scene(40, 3, 0.3)
    frames = adjust.Frames.of(*views)
    points = frames.triangulated(rig)
    for k in range(0, points.shape[1], 17):
        rows = []
        for cam, uv in zip(views[1][frames.point == k], views[2][frames.point == k], strict=True):
            seen = (uv - rig.centre[cam]) / rig.focal[cam]
            at = seen.copy()
            for _ in range(50):
                at = seen / (1 + rig.k1[cam] * at @ at)
            whole = np.column_stack((rig.turn[cam], rig.shift[cam]))
            rows += [a * whole[2] - w for a, w in zip(at, whole[:2], strict=True)]
        last = np.linalg.svd(np.array(rows))[2][-1]
        assert np.allclose(points[:, k], last[:3] / last[3], rtol=1e-6, atol=1e-6)
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(50, 4, 4)))[0]
    sums = np.einsum("nij,j,nkj->nik", turn, [0.9, 1.0, 5.0, 80.0], turn)
    got = adjust._last_directions([[sums[:, i, j] for j in range(i + 1)] for i in range(4)])
    assert np.allclose(np.abs((got.T * turn[:, :, 0]).sum(axis=1)), 1)


@pytest.mark.parametrize("rows", [0, 12, 5000])
def test_held_percentiles(spark, rows):
    """As by the whole group's values, for groups of few and many values, ties and nulls."""
    value = "CASE WHEN id % 3 = 0 THEN floor(rand(7) * 20) WHEN id % 50 > 0 THEN randn(5) END AS error"
    df = spark.range(rows).selectExpr("CASE WHEN id % 4 > 0 THEN 'a' WHEN id % 8 > 0 THEN 'b' END AS cam_a", "'c' AS cam_b", value).localCheckpoint()
    shares = {"low": 0.15, "mid": 0.5, "q1": 1.0}
    whole = lambda by: sorted(map(str, df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile("error", F.lit(p)).alias(k) for k, p in shares.items()]).collect()))
    for by, small in (([], 400), (["cam_a", "cam_b"], 400), (["cam_a", "cam_b"], 10**6)):
        assert sorted(map(str, stats.held_percentiles(df, by, "error", shares, small).collect())) == whole(by)
    assert sorted(map(str, stats.pair_percentiles(df, held=True).collect())) == sorted(map(str, stats.pair_percentiles(df).collect()))


def test_packed_views_and_scores(spark):
    """Corners that one view alone shows go, copies count once, and every corner's errors come in one row."""
    rig, views, step = _rig_scene(12, 5, 0.5)
    rows = [(int(f), "abcd"[c], int(i), float(u), float(v)) for i, c, (u, v), _, f in zip(*views, strict=True)]
    alone = [(0, "a", n, 5.0, 5.0) for n in range(35) if n not in {r[2] for r in rows if r[0] == 0}]
    df = table(spark, rows + rows[:40] + alone + [(99, "a", n, 1.0, 1.0) for n in range(9)], "frame int, camera_id string, corner_id int, u double, v double")
    frames = adjust.packed_frames(df, table(spark, BOARD, "corner_id int, bx double, by double"), ["frame"], rig.names)
    got = {r.frame: [(v.camera_id, v.corner_id, v.u, v.v) for v in r["views"]] for r in frames.collect()}
    assert got == {f: sorted([r[1:] for r in rows if r[0] == f], key=lambda v: (v[1], v[0])) for f in {r[0] for r in rows}}
    errors = adjust.Frames.of(*views).errors(rig.moved(step))
    told = {(r.frame, r.corner_id, v.camera_id): v.error for r in adjust.scored(frames, rig.moved(step), ["frame"], 0.05).collect() for v in r["views"]}
    assert len(told) == len(rows) and all(abs(told[r[0], r[2], r[1]] - e) < 1e-9 for r, e in zip(rows, errors, strict=True))
    none = adjust.adjust(df.where("frame = 99"), table(spark, BOARD, "corner_id int, bx double, by double"), rig, ["frame"], 0.05, rounds=2)
    assert none[0] is rig and [t["median"] for t in none[1]] == [None]
    sums = adjust.camera_sums(frames, rig, 0.05, 2.0, 0.0, rig)  # a limit that no corner keeps
    assert sums[3] == 0 and not sums[0].any()


# Means of many transforms

def test_robust_means_of_many_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for pair in range(6):
        turn, shift = boards.turned(rng.normal(0, 0.7, (1, 3)))[0], rng.normal(0, 50, 3)
        other = boards.turned(rng.normal(0, 0.7, (1, 3)))[0]
        truth[pair] = (turn, shift)
        for n in range(90):
            good = n % 9 != 0  # two modes: a ninth of the frames is of the other
            m = boards.turned(rng.normal(0, 0.01, (1, 3)))[0] @ (turn if good else other)
            t = shift + rng.normal(0, 0.5, 3) + (0 if good else 400)
            rows.append((pair, n, *map(float, m.ravel()), *map(float, t)))
    rows += [(9, n, *np.eye(3).ravel().tolist(), float(n), 0.0, 0.0) for n in range(2)]
    names = ", ".join(f"{c} double" for c in boards.POSE)
    df = table(spark, rows, f"pair int, frame int, {names}")
    for most in (2000, 25):  # every transform by itself; and cells of them
        monkeypatch.setattr(robust, "MOST_CELLS", most)
        got = {r.pair: r for r in robust.mean_transforms(df, ["pair"]).collect()}
        assert set(got) == {*truth, 9}
        for pair, (turn, shift) in truth.items():
            assert np.abs(np.array([got[pair][c] for c in boards.POSE[:9]]).reshape(3, 3) - turn).max() < 0.02
            assert np.abs(np.array([got[pair][c] for c in boards.POSE[9:]]) - shift).max() < 0.5
        assert got[9].t0 == pytest.approx(0.5)


def test_ward_merges_like_the_definition():
    rng = np.random.default_rng(3)
    x, w = rng.normal(0, 1, (40, 3)), rng.integers(1, 4, 40).astype(float)
    got = robust.ward(x, w, 5)
    groups = [[i] for i in range(40)]

    def cost(a, b):
        wa, wb = w[a].sum(), w[b].sum()
        gap = (x[a] * w[a, None]).sum(0) / wa - (x[b] * w[b, None]).sum(0) / wb
        return wa * wb / (wa + wb) * (gap @ gap)

    while len(groups) > 5:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    assert sorted(sorted(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())) == sorted(map(sorted, groups))


def test_fallback_to_the_better_half(spark):
    """Where no transform is near the mean, the nearer half counts, three at least."""
    turns = [boards.turned(np.array([[0.0, 0.0, a]]))[0] for a in (0.9, 1.0, 1.1, 2.0, 2.1, 2.2, 2.3)]
    rows = [(0, n, *map(float, m.ravel()), float(n), 0.0, 0.0) for n, m in enumerate(turns)]
    names = ", ".join(f"{c} double" for c in boards.POSE)
    df = table(spark, rows, f"pair int, _id long, {names}").withColumns({"v0": F.lit(0.0), "v1": F.lit(0.0), "v2": F.col("t0") / 10})
    start = table(spark, [(0, *np.eye(3).ravel().tolist(), 0.0, 0.0, 0.0)], f"pair int, {names}")
    got = robust._step(df, start, ["pair"], 0.1).first()
    assert got.t0 == pytest.approx(1.0)  # the first three of seven


def test_strict_forms_fail_on_a_miss(spark):
    from motionloom.operators import align, calibration, kinematics

    a = table(spark, [("cam0", 1.0), ("cam1", 1.0)], "camera_id string, fx double").withColumns({c: F.lit(1.0) for c in ("fy", "cx", "cy", "px", "py", "pz", *[f"r{i}{j}" for i in range(3) for j in range(3)])})
    assert calibration.compare_strictly(a, a).count() == 2
    with pytest.raises(Exception, match="cam1"):
        calibration.compare_strictly(a, a.where("camera_id = 'cam0'")).collect()
    keys = table(spark, [("cam0",), ("camera_1",)], "data_key string")
    assert {(r.data_key, r.camera_id) for r in align.match_camera_strictly(keys, a).collect()} == {("cam0", "cam0"), ("camera_1", "cam1")}
    with pytest.raises(Exception, match="cam7"):
        align.match_camera_strictly(keys.unionByName(table(spark, [("cam7",)], "data_key string")), a).collect()
    ratios = table(spark, [("thigh", 0.2)], "segment string, ratio double")
    with pytest.raises(Exception, match="height"):
        kinematics.body_seeds(ratios, table(spark, [(1, 0.0)], "label int, height double"), ["label"]).collect()


def test_axes_of_a_tensor_with_a_null(spark):
    from motionloom.operators import kinematics

    df = table(spark, [(1, 3.0, 1.0, 2.0, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0, 0.0, 0.0, 0.0)], "frame int, ixx double, iyy double, izz double, ixy double, ixz double, iyz double")
    rows = {r.frame: r for r in kinematics.principal_axes(df).collect()}
    assert (rows[1].i1, rows[1].i2, rows[1].i3) == (1.0, 2.0, 3.0) and abs(rows[1].a1y) == 1.0 and rows[2].i1 is None or np.isnan(rows[2].i1)
