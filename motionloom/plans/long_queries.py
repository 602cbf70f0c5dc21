"""Registered queries of the block forms, of waiting frames and epochs (also as replayed streams), of boards and of rigs."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adjust, asof, boards, epochs, rigid, robust, series
from ..sources import cache, npy, recordings, wire
from ..streaming import epochs as live_epochs
from ..streaming import pending, replay
from . import demo
from .queries import BONES, query, r, rounded

DAY = 86400.0
EVENTS = f"e AS ({demo.EVENTS_SQL})"

# The frame that a camera shows at a moment: clicks ask, views are frames


def _times(spark, sf_dir):
    df = demo.events(spark, sf_dir)
    times = df.where("type = 'click'").select("user", "t", "event_id")
    return times, df.where("type = 'view'").select("user", "t", F.col("event_id").alias("frame"))


BACK = 'c ASOF LEFT JOIN v ON c."user" = v."user" AND c.t >= v.t'
AHEAD = 'c ASOF LEFT JOIN v ON c."user" = v."user" AND c.t <= v.t'
ASKED = f"""WITH {EVENTS}, c AS (SELECT "user", t, event_id FROM e WHERE type = 'click'), v AS (SELECT "user", t, event_id AS frame FROM e WHERE type = 'view')"""


@query(f"{ASKED} SELECT event_id, CASE WHEN c.t - v.t <= {DAY} THEN v.frame END AS frame, round(CASE WHEN c.t - v.t <= {DAY} THEN v.t END, 3) + 0.0 AS t_found FROM {BACK}")
def asof_frames(spark, sf_dir):
    """The last frame of the same camera before each moment, not older than a day."""
    return rounded(asof.frames_at(*_times(spark, sf_dir), ["user"], DAY, 7 * DAY).select("event_id", "frame", "t_found"), 3)


@query(
    f"""{ASKED}, b AS (SELECT event_id, c.t, v.frame, v.t AS at FROM {BACK}), a AS (SELECT event_id, v.frame, v.t AS at FROM {AHEAD})
SELECT event_id, CASE WHEN b.at IS NULL OR a.at - b.t < b.t - b.at THEN a.frame ELSE b.frame END AS frame FROM b JOIN a USING (event_id)"""
)
def asof_nearest(spark, sf_dir):
    times, shown = _times(spark, sf_dir)
    return asof.asof(times, shown, ["user"], "t", ["frame"], 7 * DAY, direction="nearest").select("event_id", "frame")


# Calibration epochs: some signups load a version, all other events are frames that succeed or fail


def _frames_and_versions(spark, sf_dir):
    df = demo.events(spark, sf_dir).withColumnRenamed("user", "recording")
    ok = F.when(F.col("event_id") % 7 != 0, F.col("value") < 3)
    frames = df.where("type <> 'signup'").select("recording", F.col("event_id").alias("frame"), "t", ok.alias("ok"))
    return frames, df.where("type = 'signup' and event_id % 5 = 0").select("recording", "t", F.col("event_id").cast("string").alias("version"))


EPOCHS = f"""WITH {EVENTS}, f AS (SELECT "user" AS recording, event_id AS frame, t, CASE WHEN event_id % 7 <> 0 THEN value < 3 END AS ok FROM e WHERE type <> 'signup'),
v AS (SELECT "user" AS recording, t, event_id::VARCHAR AS version FROM e WHERE type = 'signup' AND event_id % 5 = 0),
j AS (SELECT f.*, v.version, v.t AS since FROM f ASOF LEFT JOIN v ON f.recording = v.recording AND f.t >= v.t),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY recording, since ORDER BY t) AS island FROM j),
n AS (SELECT *, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY recording, since, island ORDER BY t) AS failed FROM i),
b AS (SELECT recording, since, min(t) AS over_t FROM n WHERE failed >= 10 AND since IS NOT NULL GROUP BY 1, 2)
SELECT n.recording, frame, version, CASE WHEN n.since IS NOT NULL THEN failed END::BIGINT AS failures,
  CASE WHEN n.since IS NULL THEN 'none' WHEN t > over_t THEN 'invalid' ELSE 'valid' END AS status
FROM n LEFT JOIN b ON b.recording = n.recording AND b.since = n.since"""


@query(EPOCHS)
def calibration_epochs(spark, sf_dir):
    df = epochs.epochs(*_frames_and_versions(spark, sf_dir), ["recording"], 7 * DAY)
    return df.select("recording", "frame", "version", "failures", "status")


@query(EPOCHS)
def calibration_stream(spark, sf_dir):
    """The same from a stream of loadings and frames that is replayed in three micro-batches."""
    frames, versions = _frames_and_versions(spark, sf_dir)
    events = frames.withColumn("kind", F.lit("frame")).unionByName(versions.withColumn("kind", F.lit("load")), allowMissingColumns=True)
    rows = events.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    told = replay.played(live_epochs.epoch_stream(replay.replayed(rows, "ts", 3)), spark)
    return told.select("recording", "frame", "version", "failures", "status")


# Frames that wait for a skeleton: clicks are a recording's camera frames, views its results, both numbered in order

WAIT = 1.5 * DAY
PENDING = f"""WITH {EVENTS}, c AS (SELECT "user" AS recording, row_number() OVER w AS frame, ts, lead(ts) OVER w AS nxt FROM e WHERE type = 'click' WINDOW w AS (PARTITION BY "user" ORDER BY ts)),
v AS (SELECT "user" AS recording, row_number() OVER w AS frame, ts AS came, value, lead(ts, 2) OVER w AS gone FROM e WHERE type = 'view' WINDOW w AS (PARTITION BY "user" ORDER BY ts)),
s AS (SELECT c.recording, c.frame, value, CASE WHEN came <= ts AND (gone IS NULL OR gone > ts) OR came > ts AND came <= ts + INTERVAL 36 hour AND (nxt IS NULL OR came < nxt) THEN 'matched'
  WHEN nxt <= ts + INTERVAL 36 hour THEN 'overtaken' WHEN ts + INTERVAL 36 hour < (SELECT max(ts) FROM e WHERE type IN ('click', 'view')) THEN 'timed_out' END AS status
  FROM c LEFT JOIN v ON v.recording = c.recording AND v.frame = c.frame)
SELECT recording, frame, CASE WHEN status = 'matched' THEN value END AS result, status FROM s WHERE status IS NOT NULL"""


def _waiting(spark, sf_dir):
    df = demo.events(spark, sf_dir).where("type in ('click', 'view')")
    number = F.row_number().over(Window.partitionBy("user", "type").orderBy("ts")).cast("long")
    kind = F.when(F.col("type") == "click", "camera").otherwise("result")
    return df.select(F.col("user").alias("recording"), kind.alias("kind"), number.alias("frame"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query(PENDING)
def pending_frames(spark, sf_dir):
    """A replayed stream in three micro-batches: two results and one frame are all that a recording holds."""
    events = replay.replayed(_waiting(spark, sf_dir), "ts", 3, replay.stateful_session(spark))
    told = replay.played(pending.pending_frames(events, WAIT), spark)
    return told.select("recording", "frame", "result", "status")


@query(PENDING)
def pending_in_order(spark, sf_dir):
    return pending.pending_in_order(_waiting(spark, sf_dir), WAIT).select("recording", "frame", "result", "status")


# Rigid skeletons with learnt lengths: a recording is a label; some points were not seen, some are predicted


def _measured(spark, sf_dir):
    number = F.col("frame") * 7 + F.col("keypoint").cast("int") * 3
    seen = F.col("keypoint").isin("12") | (number % 11 >= 3)
    df = demo.points(spark, sf_dir).withColumnRenamed("label", "recording")
    df = df.withColumns({"t": F.col("frame") / 8.0, "is_predicted": number % 13 == 5})
    return df.withColumns({c: F.when(seen, F.col(c)) for c in ("x", "y", "z")})


MEASURED = f"m AS (SELECT label AS recording, frame, frame/8.0::DOUBLE AS t, keypoint, CASE WHEN keypoint = '12' OR (frame*7 + keypoint::INT*3) % 11 >= 3 THEN x END AS x, y, z, (frame*7 + keypoint::INT*3) % 13 = 5 AS is_predicted FROM ({demo.POINTS_SQL}))"
LEARNT = f"""{MEASURED}, b AS (SELECT * FROM {demo.values_sql(BONES, ['parent', 'child', 'seed'])}), g AS (SELECT * FROM m WHERE x IS NOT NULL AND NOT is_predicted),
l AS (SELECT f.recording, f.frame, f.t, b.parent, b.child, b.seed, sqrt((p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2) AS length
  FROM (SELECT DISTINCT recording, frame, t FROM m) f CROSS JOIN b LEFT JOIN g p ON p.recording = f.recording AND p.frame = f.frame AND p.keypoint = b.parent
  LEFT JOIN g c ON c.recording = f.recording AND c.frame = f.frame AND c.keypoint = b.child),
n AS (SELECT recording, frame, t, parent, child, coalesce(quantile_cont(length, 0.5) OVER (PARTITION BY recording, parent, child ORDER BY t RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), seed) AS length FROM l)"""


def _learnt(spark, sf_dir):
    bones = spark.createDataFrame(BONES, "parent string, child string, seed double")
    return rigid.measured_lengths(_measured(spark, sf_dir), bones, ["recording"], 10.0, 30.0)


@query(f"WITH {LEARNT} SELECT recording, frame, parent, child, {r('length', 'length')} FROM n")
def measured_lengths(spark, sf_dir):
    return rounded(_learnt(spark, sf_dir).select("recording", "frame", "parent", "child", "length"))


def _levels() -> str:
    """A common table a bone: its direction where the child is seen, else the last one, else up; and the held child."""
    keypoints = sorted({k for b in BONES for k in b[:2]}, key=int)
    pick = ", ".join(f"max({c}) FILTER (keypoint = '{k}' AND x IS NOT NULL) AS {c}{k}" for k in keypoints for c in "xyz")
    lengths = ", ".join(f"max(length) FILTER (child = '{c}') AS l{c}" for _, c, _ in BONES)
    sql = f"k AS (SELECT recording, frame, {pick} FROM m GROUP BY 1, 2), q AS (SELECT recording, frame, {lengths} FROM n GROUP BY 1, 2), "
    sql += "h AS (SELECT k.*, q.* EXCLUDE (recording, frame), x12 AS hx12, y12 AS hy12, z12 AS hz12 FROM k JOIN q USING (recording, frame) WHERE x12 IS NOT NULL)"
    last = "h"
    for n, (p, c, _) in enumerate(BONES):
        size = f"sqrt((x{c}-hx{p})**2 + (y{c}-hy{p})**2 + (z{c}-hz{p})**2)"
        ways = ", ".join(f"coalesce(last_value(CASE WHEN {size} > 1e-6 THEN ({a}{c}-h{a}{p})/{size} END IGNORE NULLS) OVER w, {up}) AS w{a}{c}" for a, up in zip("xyz", (0, 1, 0), strict=True))
        sql += f", d{n} AS (SELECT *, {ways} FROM {last} WINDOW w AS (PARTITION BY recording ORDER BY frame))"
        sql += f", h{n} AS (SELECT *, " + ", ".join(f"h{a}{p} + l{c}*w{a}{c} AS h{a}{c}" for a in "xyz") + f" FROM d{n})"
        last = f"h{n}"
    return sql + "".join(f" {'UNION ALL ' if n else ''}SELECT recording, frame, '{k}' AS keypoint, {r(f'hx{k}', 'x', 3)}, {r(f'hy{k}', 'y', 3)}, {r(f'hz{k}', 'z', 3)} FROM {last}" for n, k in enumerate(keypoints))


@query(f"WITH {LEARNT}, {_levels()}")
def rigid_blocks(spark, sf_dir):
    points = _measured(spark, sf_dir)
    df = rigid.rigid_blocks(points, BONES, "12", ["recording"], _learnt(spark, sf_dir), block_frames=64)
    return rounded(df.select("recording", "frame", "keypoint", "x", "y", "z"), 3)


# Boards: the pose of a frame's board follows from its embedding

CORNERS = 20
POSES_SQL = """v AS (SELECT vec_id AS frame, embedding[1]::DOUBLE*2 AS v0, embedding[2]::DOUBLE*2 AS v1, embedding[3]::DOUBLE*2 AS v2, embedding[4]::DOUBLE*300 AS t0, embedding[5]::DOUBLE*300 AS t1, 900+embedding[6]::DOUBLE*300 AS t2 FROM embeddings),
a AS (SELECT *, sqrt(v0*v0+v1*v1+v2*v2) AS n FROM v), s AS (SELECT *, sin(n)/n AS p, (1-cos(n))/(n*n) AS q FROM a),
pose AS (SELECT frame, 1-q*(v1*v1+v2*v2) AS r00, q*v0*v1-p*v2 AS r01, q*v0*v2+p*v1 AS r02, q*v0*v1+p*v2 AS r10, 1-q*(v0*v0+v2*v2) AS r11, q*v1*v2-p*v0 AS r12,
  q*v0*v2-p*v1 AS r20, q*v1*v2+p*v0 AS r21, 1-q*(v0*v0+v1*v1) AS r22, t0, t1, t2 FROM s)"""


def _poses(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    df = demo.embeddings(spark, sf_dir).select(F.col("vec_id").alias("frame"), *[(e(k) * 2).alias(f"v{k}") for k in range(3)], (e(3) * 300).alias("t0"), (e(4) * 300).alias("t1"), (900 + e(5) * 300).alias("t2"))
    v0, v1, v2 = F.col("v0"), F.col("v1"), F.col("v2")
    n = F.sqrt(v0 * v0 + v1 * v1 + v2 * v2)
    df = df.withColumns({"p": F.sin(n) / n, "q": (1 - F.cos(n)) / (n * n)})
    p, q = F.col("p"), F.col("q")
    turn = [1 - q * (v1 * v1 + v2 * v2), q * v0 * v1 - p * v2, q * v0 * v2 + p * v1, q * v0 * v1 + p * v2, 1 - q * (v0 * v0 + v2 * v2), q * v1 * v2 - p * v0, q * v0 * v2 - p * v1, q * v1 * v2 + p * v0, 1 - q * (v0 * v0 + v1 * v1)]
    return df.select("frame", *[c.alias(f"r{i // 3}{i % 3}") for i, c in enumerate(turn)], "t0", "t1", "t2")


def _board(spark):
    return spark.range(CORNERS).select(F.col("id").cast("int").alias("corner_id"), ((F.col("id") % 5) * 40.0).alias("bx"), (F.floor(F.col("id") / 5) * 40.0).alias("by"))


def _board_views(spark, sf_dir, distorted: bool):
    """A frame's board through one camera of the rig; some corners are hidden."""
    names = ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"]
    cameras = demo.cameras(spark).select("camera_id", *[(F.col(c) if distorted or c[0] in "fc" else F.lit(0.0)).alias(c) for c in names])
    df = _poses(spark, sf_dir).withColumn("camera_id", F.concat(F.lit("cam"), F.col("frame") % 4)).join(F.broadcast(cameras), "camera_id")  # four constant rows
    corner = F.explode(F.sequence(F.lit(0), F.lit(CORNERS - 1))).alias("corner_id")
    df = df.select("*", corner).where("(frame * 3 + corner_id * 5) % 13 > 2")
    bx, by = (F.col("corner_id") % 5) * 40.0, F.floor(F.col("corner_id") / 5) * 40.0
    at = [F.col(f"r{i}0") * bx + F.col(f"r{i}1") * by + F.col(f"t{i}") for i in range(3)]
    df = df.withColumns({"a": at[0] / at[2], "b": at[1] / at[2]})
    a, b = F.col("a"), F.col("b")
    r2 = a * a + b * b
    rad = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
    u = F.col("fx") * (a * rad + 2 * F.col("p1") * a * b + F.col("p2") * (r2 + 2 * a * a)) + F.col("cx")
    v = F.col("fy") * (b * rad + F.col("p1") * (r2 + 2 * b * b) + 2 * F.col("p2") * a * b) + F.col("cy")
    return df.select("camera_id", "frame", "corner_id", u.alias("u"), v.alias("v"))


@query(f"WITH {POSES_SQL} SELECT 'cam' || (frame % 4) AS camera_id, frame, " + ", ".join(r(c, c, 5) for c in boards.POSE) + ", 0.0::DOUBLE AS rms FROM pose")
def board_poses(spark, sf_dir):
    views = boards.views_of(_board_views(spark, sf_dir, True), _board(spark), ["camera_id", "frame"])
    return rounded(boards.board_poses(views, demo.cameras(spark), ["camera_id", "frame"]), 5)


@query(f"SELECT c.camera_id, n.n_views, {', '.join(r(c, c, 2) for c in ('fx', 'fy', 'cx', 'cy'))} FROM {demo.CAMERAS_SQL} c JOIN (SELECT 'cam' || (vec_id % 4) AS camera_id, count(*) AS n_views FROM embeddings GROUP BY 1) n USING (camera_id)")
def board_intrinsics(spark, sf_dir):
    """Cameras without distortion, found again from the boards that they saw."""
    views = boards.views_of(_board_views(spark, sf_dir, False), _board(spark), ["camera_id", "frame"])
    found = boards.board_homographies(views, ["camera_id", "frame"])
    return rounded(boards.intrinsics(boards.intrinsic_sums(found, ["camera_id"]), ["camera_id"]), 2)


# A rig that was moved, found again from boards before it


def _rig() -> adjust.Rig:
    rows = {row[0]: row for row in demo.CAMERAS}
    names = tuple(rows)
    pick = lambda lo, hi: np.array([rows[n][lo:hi] for n in names], float)
    focal = pick(13, 14)[:, 0]
    return adjust.Rig(names, pick(1, 10).reshape(-1, 3, 3), pick(10, 13), focal, pick(17, 18)[:, 0], pick(15, 17))


@query("SELECT camera_id, " + ", ".join(r(c, c, 2) for c in ("t0", "t1", "t2", "fx")) + f", {r('k1', 'k1', 4)} FROM {demo.CAMERAS_SQL}")
def rig_adjustment(spark, sf_dir):
    """Views of every frame's board in all cameras; the adjustment starts at a rig whose cameras but the first were moved."""
    true = _rig()
    number = F.transform(F.array(*[F.lit(n) for n in true.names]), lambda n: n)
    df = _poses(spark, sf_dir).repartition("frame").select("*", F.posexplode(number).alias("cam", "camera_id"))  # before a frame becomes 80 rows
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(CORNERS - 1))).alias("corner_id"))
    bx, by = (F.col("corner_id") % 5) * 40.0, F.floor(F.col("corner_id") / 5) * 40.0
    world = [F.col(f"r{i}0") * bx + F.col(f"r{i}1") * by + (F.col(f"t{i}") if i < 2 else F.col("t2") + 600) for i in range(3)]
    names = ["frame", "camera_id", "corner_id"]
    placed = df.select(*names, "cam", *[w.alias(c) for w, c in zip(world, "xyz", strict=True)])

    def see(batches):
        for batch in batches:
            cam, *xyz = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cam", *"xyz"))
            uv = true.pixels(cam, np.column_stack(xyz))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(c, from_pandas=True) for c in uv.T)], [*names, "u", "v"])

    views = placed.mapInArrow(see, "frame long, camera_id string, corner_id int, u double, v double")
    off = np.array([0.0] * 8 + [0.002, -0.001, 0.001, 3, -4, 2, 3, 0.002] * 3)
    found, _ = adjust.adjust(views, _board(spark), true.moved(off), ["frame"], 2 / 40, rounds=3, steps=3, enough=1e-9)
    rows = [(n, *map(float, t), float(f), float(k)) for n, t, f, k in zip(found.names, found.shift, found.focal, found.k1, strict=True)]
    told = spark.createDataFrame(rows, "camera_id string, t0 double, t1 double, t2 double, fx double, k1 double")  # the rig: a row a camera
    return told.select("camera_id", *[(F.round(c, 4 if c == "k1" else 2) + 0.0).alias(c) for c in told.columns[1:]])


# Means of transforms: a pair is a label, every eighth frame shows another mode


@query(
    f"""WITH g AS (SELECT label, avg(0.3*label + embedding[1]::DOUBLE*0.05) AS th, avg(embedding[2]::DOUBLE*5) AS t0, avg(10*label + embedding[3]::DOUBLE*5) AS t1, avg(embedding[4]::DOUBLE*5) AS t2
FROM embeddings WHERE vec_id % 8 <> 0 GROUP BY 1)
SELECT label, {r('cos(th)', 'r00')}, {r('-sin(th)', 'r01')}, {r('sin(th)', 'r10')}, {r('t0', 't0')}, {r('t1', 't1')}, {r('t2', 't2')} FROM g"""
)
def transform_means(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    other = F.col("vec_id") % 8 == 0
    angle = 0.3 * F.col("label") + e(0) * 0.05 + F.when(other, 1.2 + e(5)).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    entries = [F.cos("th"), -F.sin("th"), zero, F.sin("th"), F.cos("th"), zero, zero, zero, one]
    df = demo.embeddings(spark, sf_dir).select("label", angle.alias("th"), (e(1) * 5 + F.when(other, 300).otherwise(0)).alias("t0"), (10 * F.col("label") + e(2) * 5).alias("t1"), (e(3) * 5).alias("t2"))
    df = df.select("label", *[c.alias(n) for c, n in zip(entries, boards.POSE[:9], strict=True)], "t0", "t1", "t2")
    return rounded(robust.mean_transforms(df, ["label"]).select("label", "r00", "r01", "r10", "t0", "t1", "t2"))


# Long series in blocks


@query()
def filled_and_smoothed(spark, sf_dir):
    """Gaps filled by splines, then the low-pass; tests hold both against the whole series."""
    seen = (F.col("frame") * 7 + F.col("keypoint").cast("int")) % 9 > 2
    df = demo.points(spark, sf_dir).select("keypoint", "frame", *[F.when(seen, F.col(c)).alias(c) for c in "xyz"])
    return rounded(series.fill_and_smooth(df, ["keypoint"], "frame", ["x", "y", "z"], 30.0, 6.0, 256.0, block_samples=256), 4)




# Sinks: what is written comes back


@query(f"SELECT label AS recording, frame, keypoint, {r('x::FLOAT::DOUBLE', 'x', 3)}, {r('y::FLOAT::DOUBLE', 'y', 3)}, {r('z::FLOAT::DOUBLE', 'z', 3)} FROM ({demo.POINTS_SQL}) WHERE keypoint <> '4' OR frame % 3 > 0")
def wire_round_trip(spark, sf_dir):
    """Every frame as a binary message and back; some points are not there, and come back as not seen."""
    points = demo.points(spark, sf_dir).where("keypoint <> '4' or frame % 3 > 0").withColumnRenamed("label", "recording")
    points = points.select("*", F.lit("").alias("camera_id"), F.lit("body").alias("tracker_id"))
    names = spark.range(demo.KEYPOINTS).select(F.lit("body").alias("tracker_id"), F.col("id").cast("string").alias("keypoint"), F.col("id").cast("int").alias("ord"))
    messages = wire.encoded(wire.blocks(points, names, ["recording"]), ["recording"], embed_names=True)
    seen = wire.decoded(messages, ["recording"]).where("visibility > 0")
    return rounded(seen.select("recording", "frame", F.col("name").alias("keypoint"), "x", "y", "z"), 3)


CACHED = f"""WITH {EVENTS}, f AS (SELECT 'r' || ("user" % 3) AS recording, type AS camera_id, event_id AS frame, event_id + 1000 AS connection_frame, value FROM e)
SELECT recording, camera_id, frame, CASE WHEN frame % 4 > 0 THEN {r('value', 'x')[:-5]} END AS x FROM f"""


@query(CACHED)
def observation_cache(spark, sf_dir):
    """Observations by connection frame are written and found again by recording frame; frames that were dropped have none."""
    df = demo.events(spark, sf_dir)
    frames = df.select(F.concat(F.lit("r"), F.col("user") % 3).alias("recording"), F.col("type").alias("camera_id"), F.col("event_id").alias("frame"), (F.col("event_id") + 1000).alias("connection_frame"), F.col("value").alias("x"))
    folder = replay.shared_folder(spark, "observations")
    board = cache.Board(7, 5, 58.0, "DICT_4X4_250")
    kept = frames.where("frame % 4 > 0").withColumns({"corner_id": F.lit(0), "y": F.lit(0.0)})
    cache.write_cache(kept, folder, board)
    hits, misses = cache.recalled(frames.drop("x"), cache.cached_observations(spark, folder, board))
    told = hits.select("recording", "camera_id", "frame", "x").unionByName(misses, allowMissingColumns=True)
    return rounded(told)


@query(f"SELECT 'label' || label AS camera_id, frame, keypoint::BIGINT AS point, {r('x', 'v0')}, {r('y', 'v1')}, {r('z', 'v2')} FROM ({demo.POINTS_SQL})")
def array_round_trip(spark, sf_dir):
    """Points as arrays of a camera (a label) and back, in ranges of 100 frames."""
    rows = demo.points(spark, sf_dir).select(F.concat(F.lit("label"), "label").alias("camera_id"), "frame", F.col("keypoint").cast("long").alias("point"), F.col("x").alias("v0"), F.col("y").alias("v1"), F.col("z").alias("v2"))
    folder = replay.shared_folder(spark, "arrays")
    npy.write_npy(rows, folder, demo.KEYPOINTS, frames_per_task=100)
    return rounded(npy.read_npy(spark, folder, frames_per_task=100))


# Recording folders: a user is a recording, an event type a camera with its timestamps


@query(
    f"""WITH {EVENTS}, c AS (SELECT 'rec' || "user" % 10 AS recording, type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT recording, count(*) AS n_cameras, min(n) = max(n) AS in_sync, CASE WHEN min(n) = max(n) THEN max(n) END AS n_frames, 'output/a_body_3d_xyz.csv' AS body_csv, 'body' AS tracker FROM c GROUP BY 1"""
)
def recording_bundles(spark, sf_dir):
    """Folders of ten recordings are written from events and read back as one row each."""
    df = demo.events(spark, sf_dir).withColumn("recording", F.concat(F.lit("rec"), F.col("user") % 10))
    root = replay.shared_folder(spark, "recordings")
    rows = df.select("recording", "type", "t").repartition("recording", "type")
    written = f"{root}-tables"
    rows.sortWithinPartitions("recording", "type", "t").write.partitionBy("recording", "type").option("header", True).csv(written)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = place(root).getFileSystem(conf)

    def text(path: str, content: str) -> None:
        out = system.create(place(path), True)
        out.write(bytearray(content.encode()))
        out.close()

    for folder in system.listStatus(place(written)):
        name = folder.getPath().getName()
        if not name.startswith("recording="):
            continue
        recording = name.removeprefix("recording=")
        for camera in system.listStatus(folder.getPath()):  # a recording's few cameras, one file each
            kind = camera.getPath().getName().removeprefix("type=")
            system.mkdirs(place(f"{root}/{recording}/timestamps"))
            part = next(f.getPath() for f in system.listStatus(camera.getPath()) if f.getPath().getName().startswith("part-"))
            system.rename(part, place(f"{root}/{recording}/timestamps/{kind}.csv"))
        text(f"{root}/{recording}/output/b_body_3d_xyz.csv", "frame")
        text(f"{root}/{recording}/output/a_body_3d_xyz.csv", "frame")
        text(f"{root}/{recording}/tracker_schema.json", recordings.schema_text("body", "demo", ["a"], []))
    return recordings.bundles(spark, root).select("recording", "n_cameras", "in_sync", "n_frames", "body_csv", "tracker")
