"""Registered queries of the motion operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import names
from ..operators import align, calibration, gates, kinematics, rigid, series, stats, temporal, triangulate, windows
from ..sources import files
from ..streaming import frames as live
from . import demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, so that engines that sum in another order agree."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# Segments and shape

LENGTHS = f"""lengths AS (
  SELECT f.frame, s.segment, s.pair, s.ratio, s.mass, s.com, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS length,
    a.x AS px, a.y AS py, a.z AS pz, b.x AS dx, b.y AS dy, b.z AS dz
  FROM (SELECT DISTINCT frame FROM ({demo.POINTS_SQL})) f, {demo.SEGMENTS_SQL} s
  LEFT JOIN ({demo.POINTS_SQL}) a ON a.frame = f.frame AND a.keypoint = s.proximal
  LEFT JOIN ({demo.POINTS_SQL}) b ON b.frame = f.frame AND b.keypoint = s.distal)"""
STATS = """stats AS (
  SELECT segment, pair, any_value(ratio) AS ratio, count(*) AS n_frames, count(length) AS n_valid, avg(length) AS mean, median(length) AS median,
    stddev_pop(length) AS std, min(length) AS min, max(length) AS max FROM lengths GROUP BY segment, pair),
full_stats AS (SELECT s.*, m.mad, 1.4826*m.mad/s.median AS cv FROM stats s JOIN (
  SELECT l.segment, median(abs(l.length - s.median)) AS mad FROM lengths l JOIN stats s USING (segment) GROUP BY 1) m USING (segment))"""


def _lengths(spark, sf_dir, where=None):
    points = demo.points(spark, sf_dir)
    return stats.segment_lengths(points.where(where) if where else points, demo.segments(spark))


def _usable(spark, sf_dir, where=None):
    return stats.assessable(stats.segment_stats(_lengths(spark, sf_dir, where)), demo.segments(spark).select("segment", "ratio"))


@query(f"WITH {LENGTHS} SELECT frame, segment, pair, {r('length', 'length')} FROM lengths")
def segment_lengths(spark, sf_dir):
    return rounded(_lengths(spark, sf_dir))


@query(
    f"WITH {LENGTHS}, {STATS} SELECT segment, pair, n_frames, n_valid, {r('mean', 'mean')}, {r('median', 'median')}, {r('std', 'std')}, "
    f"{r('min', 'min')}, {r('max', 'max')}, {r('mad', 'mad')}, {r('cv', 'cv')} FROM full_stats"
)
def segment_stats(spark, sf_dir):
    return rounded(stats.segment_stats(_lengths(spark, sf_dir)))


@query(
    f"""WITH {LENGTHS}, {STATS},
sides AS (SELECT pair, max(median) FILTER (segment LIKE 'left_%') AS l, max(median) FILTER (segment LIKE 'right_%') AS r FROM full_stats GROUP BY pair),
diffs AS (SELECT pair, abs(l-r)/((l+r)/2) AS diff FROM sides WHERE l IS NOT NULL AND r IS NOT NULL),
one AS (SELECT count(*) AS n_assessable, median(median/ratio) AS height, stddev_pop(median/ratio)/median(median/ratio) AS height_cv FROM full_stats),
v AS (
  SELECT 1 AS o, 'proportion' AS what FROM one WHERE height_cv > 0.15 UNION ALL
  SELECT 2, 'height' FROM one WHERE NOT height BETWEEN 1000 AND 2200 UNION ALL
  SELECT 3, 'rigidity:' || segment FROM full_stats WHERE cv > 0.15 UNION ALL
  SELECT 4, 'symmetry:' || pair FROM diffs WHERE diff > 0.15)
SELECT n_assessable, {r('height', 'height')}, {r('height_cv', 'height_cv')},
  coalesce((SELECT string_agg(what, ',' ORDER BY o, what) FROM v), '') AS violations, NOT EXISTS (SELECT 1 FROM v) AS passes FROM one"""
)
def human_shape_verdict(spark, sf_dir):
    return rounded(stats.human_shape(_usable(spark, sf_dir)))


@query(
    f"""WITH {LENGTHS}, {STATS} SELECT pair, {r('abs(l-r)/((l+r)/2)', 'diff')} FROM (
SELECT pair, max(median) FILTER (segment LIKE 'left_%') AS l, max(median) FILTER (segment LIKE 'right_%') AS r FROM full_stats GROUP BY pair)
WHERE l IS NOT NULL AND r IS NOT NULL"""
)
def symmetry(spark, sf_dir):
    return rounded(stats.symmetry(_usable(spark, sf_dir)))


@query(
    f"""WITH {LENGTHS}, parts AS (SELECT segment, median(length) FILTER (frame IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)) AS a,
  median(length) FILTER (frame IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)) AS b FROM lengths GROUP BY 1)
SELECT segment, {r('abs(a-b)/b', 'diff')}, abs(a-b)/b <= 0.25 AS equivalent FROM parts"""
)
def equivalence(spark, sf_dir):
    return rounded(stats.equivalence(_usable(spark, sf_dir, "label % 2 = 0"), _usable(spark, sf_dir, "label % 2 = 1")))


# Cameras

def _projected(spark, sf_dir):
    return cam.project(demo.seen(spark, sf_dir))


@query(f"SELECT frame, keypoint, camera_id, {r('u', 'u')}, {r('v', 'v')} FROM ({demo.PROJECTED_SQL})")
def project_points(spark, sf_dir):
    return rounded(_projected(spark, sf_dir).select("frame", "keypoint", "camera_id", "u", "v"))


@query(f"SELECT frame, keypoint, camera_id, {r('a', 'un')}, {r('b', 'vn')} FROM ({demo.PROJECTED_SQL})")
def undistort_points(spark, sf_dir):
    return rounded(cam.undistort(_projected(spark, sf_dir), iterations=10).select("frame", "keypoint", "camera_id", "un", "vn"))


GATED = f"(SELECT *, CASE WHEN visibility >= 0.5 THEN u END AS gu FROM ({demo.PROJECTED_SQL}))"


@query(f"SELECT camera_id, count(*) AS n, count(gu) AS n_kept, {r('avg(gu)', 'mean_u', 4)} FROM {GATED} GROUP BY 1")
def confidence_gate(spark, sf_dir):
    obs = _projected(spark, sf_dir).select("camera_id", F.col("u").alias("x"), F.col("v").alias("y"), "visibility")
    kept = gates.confidence(obs, 0.5)
    return rounded(kept.groupBy("camera_id").agg(F.count("*").alias("n"), F.count("x").alias("n_kept"), F.avg("x").alias("mean_u")), 4)


@query(f"SELECT frame, keypoint, n_cameras FROM (SELECT frame, keypoint, count(gu) AS n_cameras FROM {GATED} GROUP BY 1, 2) WHERE n_cameras >= 2")
def two_camera_points(spark, sf_dir):
    obs = _projected(spark, sf_dir).select("frame", "keypoint", F.col("u").alias("x"), F.col("v").alias("y"), "visibility")
    return gates.seen_by(gates.confidence(obs, 0.5)).select("frame", "keypoint", "n_cameras").distinct()


SHIFTED_ERRORS = f"(SELECT frame, keypoint, sqrt(9*visibility*visibility*400 + 16*visibility*visibility*400) AS error, gu, x, y, z FROM {GATED})"


def _shifted(spark, sf_dir):
    """Errors of observations moved by (60, 80) pixels times their visibility; those of poor visibility are not observed."""
    df = _projected(spark, sf_dir)
    dx, dy = F.col("u") + 60 * F.col("visibility"), F.col("v") + 80 * F.col("visibility")
    df = df.withColumn("error", F.when(F.col("visibility") >= 0.5, cam.pixel_error(dx, dy, F.col("u"), F.col("v"))))
    return df


@query(
    f"""SELECT frame, keypoint, n_cameras, {r('mean_error', 'mean_error', 4)}, round(CASE WHEN NOT coalesce(mean_error > 60.05, false) THEN x END, 4) + 0.0 AS x FROM (
SELECT frame, keypoint, count(gu) AS n_cameras, CASE WHEN count(gu) >= 2 THEN avg(error) FILTER (gu IS NOT NULL) END AS mean_error, any_value(x) AS x
FROM {SHIFTED_ERRORS} GROUP BY 1, 2)"""
)
def reprojection_gate(spark, sf_dir):
    errors = gates.mean_error(_shifted(spark, sf_dir))
    joined = demo.points(spark, sf_dir).join(errors, ["frame", "keypoint"])
    return rounded(gates.reprojection(joined, 60.05).select("frame", "keypoint", "n_cameras", "mean_error", "x"), 4)


@query(f"SELECT frame, keypoint, 4 AS n_cameras, {r('x', 'x', 4)}, {r('y', 'y', 4)}, {r('z', 'z', 4)} FROM ({demo.POINTS_SQL})")
def triangulate_plain(spark, sf_dir):
    obs = _projected(spark, sf_dir).select("frame", "keypoint", "camera_id", F.col("a").alias("un"), F.col("b").alias("vn"))
    return rounded(triangulate.triangulate(obs, demo.cameras(spark)).drop("weights"), 4)


@query(f"SELECT frame, keypoint, count(gu)::INT AS n_cameras, {r('any_value(x)', 'x', 4)}, {r('any_value(y)', 'y', 4)}, {r('any_value(z)', 'z', 4)} FROM {GATED} GROUP BY 1, 2 HAVING count(gu) >= 2")
def triangulate_ensemble(spark, sf_dir):
    """Noise-free, with poor views taken away: the ensemble must leave exact solutions alone."""
    df = _projected(spark, sf_dir).where("visibility >= 0.5")
    obs = df.select("frame", "keypoint", "camera_id", F.col("a").alias("un"), F.col("b").alias("vn"))
    return rounded(triangulate.triangulate(obs, demo.cameras(spark), triangulate.Rejection()).drop("weights"), 4)


@query(
    f"""WITH p AS (SELECT * FROM ({demo.PROJECTED_SQL}) WHERE camera_id = 'cam0'), e AS (SELECT min(u) AS lo, max(u) AS hi, max(v) AS top FROM p)
SELECT frame, keypoint, {r('u - (lo + hi)/2', 'x', 4)}, 0.0::DOUBLE AS y, {r('top - v', 'z', 4)} FROM p, e"""
)
def planar_projection(spark, sf_dir):
    one = _projected(spark, sf_dir).where("camera_id = 'cam0'").select("frame", "keypoint", "u", "v", F.lit(0).alias("recording_id"))
    return rounded(cam.planar_recording(one).select("frame", "keypoint", "x", "y", "z"), 4)


@query(f"SELECT frame, keypoint, {r('u - 320', 'x', 4)}, 0.0::DOUBLE AS y, {r('480 - v', 'z', 4)} FROM ({demo.PROJECTED_SQL}) WHERE camera_id = 'cam0'")
def planar_projection_frame(spark, sf_dir):
    one = _projected(spark, sf_dir).where("camera_id = 'cam0'")
    x, y, z = cam.planar_frame(F.col("u"), F.col("v"), F.lit(640.0), F.lit(480.0))
    return rounded(one.select("frame", "keypoint", x.alias("x"), y.alias("y"), z.alias("z")), 4)


# Alignment of cameras: a camera is an event type, a frame a user

OBS_SQL = 'SELECT DISTINCT "user" AS frame, type AS camera_id FROM (' + demo.EVENTS_SQL + ")"


def _obs(spark, sf_dir):
    return demo.events(spark, sf_dir).select(F.col("user").alias("frame"), F.col("type").alias("camera_id"), "value", "t")


@query(f"SELECT frame, count(*) AS n_cameras, count(*) = 5 AS complete FROM ({OBS_SQL}) GROUP BY 1")
def frame_completeness(spark, sf_dir):
    return align.completeness(_obs(spark, sf_dir), 5)


DAYS_SQL = f'SELECT DISTINCT "user"*100 + day(ts) AS frame, type AS camera_id FROM ({demo.EVENTS_SQL})'


def _days(spark, sf_dir):
    """A frame is a user's day, so that few cameras have all frames."""
    return demo.events(spark, sf_dir).select((F.col("user") * 100 + F.dayofmonth("ts")).alias("frame"), F.col("type").alias("camera_id"))


@query(f"WITH o AS ({DAYS_SQL}) SELECT frame, camera_id FROM (SELECT DISTINCT frame FROM o), (SELECT DISTINCT camera_id FROM o) EXCEPT SELECT frame, camera_id FROM o")
def missing_frames(spark, sf_dir):
    return align.missing(_days(spark, sf_dir))


@query(f"WITH o AS ({OBS_SQL}) SELECT a.camera_id AS cam_a, b.camera_id AS cam_b, count(*) AS n_shared FROM o a JOIN o b ON a.frame = b.frame AND a.camera_id < b.camera_id GROUP BY 1, 2")
def shared_counts(spark, sf_dir):
    return align.shared_counts(_obs(spark, sf_dir))


PAIR_ERRORS = f"""WITH o AS (SELECT "user" AS frame, type AS camera_id, avg(value) AS e FROM ({demo.EVENTS_SQL}) GROUP BY 1, 2),
p AS (SELECT a.camera_id AS cam_a, b.camera_id AS cam_b, a.frame, (a.e + b.e)/2 AS error FROM o a JOIN o b ON a.frame = b.frame AND a.camera_id < b.camera_id)"""


def _pair_errors(spark, sf_dir):
    means = _obs(spark, sf_dir).groupBy("frame", "camera_id").agg(F.avg("value").alias("e"))
    side = lambda s: means.select("frame", F.col("camera_id").alias(f"cam_{s}"), F.col("e").alias(s))
    pairs = align.camera_pairs(means).join(side("a"), ["frame", "cam_a"]).join(side("b"), ["frame", "cam_b"])
    return pairs.select("cam_a", "cam_b", "frame", ((F.col("a") + F.col("b")) / 2).alias("error"))


@query(f"{PAIR_ERRORS} SELECT cam_a, cam_b, count(*) AS n, {r('quantile_cont(error, 0.15)', 'low')}, {r('quantile_cont(error, 0.75)', 'high')} FROM p GROUP BY 1, 2 HAVING count(*) > 10")
def pair_percentiles(spark, sf_dir):
    return rounded(stats.pair_percentiles(_pair_errors(spark, sf_dir)))


@query(f"{PAIR_ERRORS} SELECT cam_a, cam_b, frame, rank FROM (SELECT *, row_number() OVER (PARTITION BY cam_a, cam_b ORDER BY round(error, 6) DESC, frame)::INT AS rank FROM p) WHERE rank <= 25")
def top_points_per_pair(spark, sf_dir):
    ranked = gates.top_per_key(_pair_errors(spark, sf_dir), ["cam_a", "cam_b"], [F.desc(F.round("error", 6)), "frame"], 25)
    return ranked.select("cam_a", "cam_b", "frame", "rank")


@query(
    f"""WITH o AS (SELECT DISTINCT "user" % 3 AS recording, day(ts) AS frame, type AS camera_id FROM ({demo.EVENTS_SQL}) WHERE event_id % 5 > 1)
SELECT a.recording, a.camera_id AS cam_a, b.camera_id AS cam_b, count(*) AS n_shared FROM o a JOIN o b ON a.recording = b.recording AND a.frame = b.frame AND a.camera_id < b.camera_id GROUP BY 1, 2, 3"""
)
def shared_counts_of_recordings(spark, sf_dir):
    """Three recordings whose frames have the same numbers and must not meet."""
    df = demo.events(spark, sf_dir).where("event_id % 5 > 1")
    obs = df.select((F.col("user") % 3).alias("recording"), F.dayofmonth("ts").alias("frame"), F.col("type").alias("camera_id"))
    return align.shared_counts(obs, by=("recording",))


@query(f"WITH o AS ({DAYS_SQL}) SELECT frame, 'a' AS only_in FROM o WHERE camera_id = 'click' AND frame NOT IN (SELECT frame FROM o WHERE camera_id = 'error') UNION ALL SELECT frame, 'b' FROM o WHERE camera_id = 'error' AND frame NOT IN (SELECT frame FROM o WHERE camera_id = 'click')")
def frame_set_difference(spark, sf_dir):
    obs = _days(spark, sf_dir)
    return align.same_ids(obs.where("camera_id = 'click'"), obs.where("camera_id = 'error'"), "frame")


@query(f"SELECT \"user\", max_by(type, (t, event_id)) AS type, max(t) AS t FROM ({demo.EVENTS_SQL}) GROUP BY 1")
def latest_per_user(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", F.struct("t", "event_id").alias("at"), "type")
    return gates.latest(df, ["user"], "at").select("user", "type", "at.t")


# Order and time: a keypoint is a user

@query(
    f"""SELECT "user", t, {r('rolling', 'rolling')} FROM (SELECT "user", t, quantile_cont(value, 0.5) OVER (PARTITION BY "user" ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS rolling FROM ({demo.EVENTS_SQL}))"""
)
def rolling_median_time(spark, sf_dir):
    return rounded(windows.rolling_median_time(demo.events(spark, sf_dir), "user", "t", "value", 86400).select("user", "t", "rolling"))


@query(
    f"""SELECT "user", t, count(value) OVER w AS rolling_n, {r('avg(value) OVER w', 'rolling_mean')}, {r('quantile_cont(value, 0.5) OVER w', 'rolling_median')}
FROM ({demo.EVENTS_SQL}) WINDOW w AS (PARTITION BY "user" ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def rolling_last_n(spark, sf_dir):
    df = windows.rolling_last(demo.events(spark, sf_dir), "user", ["t", "event_id"], "value", 10)
    return rounded(df.select("user", "t", "rolling_n", "rolling_mean", "rolling_median"))


@query(
    f"""WITH e AS (SELECT "user", t, value, t - lag(t) OVER w AS dt, lag(value) OVER w AS v0 FROM ({demo.EVENTS_SQL}) WINDOW w AS (PARTITION BY "user" ORDER BY t)),
s AS (SELECT *, CASE WHEN dt > 0 THEN (value - v0)/dt END AS v FROM e),
a AS (SELECT *, lag(v) OVER w AS v1, lag(dt) OVER w AS dt0 FROM s WINDOW w AS (PARTITION BY "user" ORDER BY t))
SELECT "user", t, {r('v', 'v_value', 9)}, round(CASE WHEN dt > 0 AND dt0 > 0 THEN (v - v1)/(0.5*(dt + dt0)) END, 9) + 0.0 AS a_value FROM a"""
)
def derivatives(spark, sf_dir):
    df = windows.derivatives(demo.events(spark, sf_dir), "user", "t", ["value"])
    return rounded(df.select("user", "t", "v_value", "a_value"), 9)


HELD = f'SELECT "user", t, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM ({demo.EVENTS_SQL})'


@query(
    f"""WITH e AS ({HELD}), k AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(value IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1, first_value(value IGNORE NULLS) OVER f AS y1 FROM e
  WINDOW b AS (PARTITION BY "user" ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY "user" ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT "user", t, {r('coalesce(value, CASE WHEN t1 > t0 THEN y0 + (y1 - y0)*(t - t0)/(t1 - t0) END, y0, y1)', 'value')} FROM k"""
)
def linear_gap_fill(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", "t", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rounded(windows.fill_linear(df, "user", "t", ["value"]))


@query(
    f"""WITH m AS (SELECT "user", t, value AS motion, row_number() OVER (PARTITION BY "user" ORDER BY t) AS i FROM ({demo.EVENTS_SQL})),
g AS (SELECT *, i - row_number() OVER (PARTITION BY "user" ORDER BY t) AS g FROM m WHERE motion < 60),
runs AS (SELECT "user", g, min(t) AS start, count(*) + 1 AS n_frames, avg(motion) AS mean_motion FROM g GROUP BY 1, 2 HAVING count(*) + 1 >= 5)
SELECT "user", start, n_frames, {r('mean_motion', 'mean_motion')} FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n_frames DESC, mean_motion, start) AS k FROM runs) WHERE k = 1"""
)
def stable_run(spark, sf_dir):
    motion = demo.events(spark, sf_dir).select("user", "t", F.col("value").alias("motion"))
    return rounded(windows.stable_runs(motion, "user", "t", 60.0, 5))


#: Every ninth event was not observed: such a row stays null and leaves a filter's state as it is, but moves the clock of a gate.
GAPS = f'SELECT *, t - lag(t) OVER (PARTITION BY "user" ORDER BY t) AS dt FROM ({demo.EVENTS_SQL})'
ORDERED = f'SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY t) AS i FROM ({GAPS}) WHERE event_id % 9 <> 4'
UNSEEN = f'FROM ({demo.EVENTS_SQL}) WHERE event_id % 9 = 4'


def _observed(spark, sf_dir):
    return demo.events(spark, sf_dir).select("user", "t", F.when(F.col("event_id") % 9 != 4, F.col("value")).alias("value"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({ORDERED}), f AS (
  SELECT "user", i, t, value AS x, 0.0::DOUBLE AS dx FROM e WHERE i = 1
  UNION ALL
  SELECT e."user", e.i, e.t,
    a(2*pi()*(0.0001 + 0.01*abs(d.dxh))*(e.t - f.t))*e.value + (1 - a(2*pi()*(0.0001 + 0.01*abs(d.dxh))*(e.t - f.t)))*f.x, d.dxh
  FROM f JOIN e ON e."user" = f."user" AND e.i = f.i + 1,
  LATERAL (SELECT a(2*pi()*0.001*(e.t - f.t))*(e.value - f.x)/(e.t - f.t) + (1 - a(2*pi()*0.001*(e.t - f.t)))*f.dx AS dxh) d)
SELECT "user", t, {r('x', 'value_out')} FROM f UNION ALL SELECT "user", t, NULL {UNSEEN}""".replace("a(2*pi()*(0.0001 + 0.01*abs(d.dxh))*(e.t - f.t))", "(1 - 1/(1 + 2*pi()*(0.0001 + 0.01*abs(d.dxh))*(e.t - f.t)))").replace("a(2*pi()*0.001*(e.t - f.t))", "(1 - 1/(1 + 2*pi()*0.001*(e.t - f.t)))")
)
def one_euro(spark, sf_dir):
    df = _observed(spark, sf_dir)
    return rounded(temporal.one_euro(df, ["user"], "t", ["value"], min_cutoff=0.0001, beta=0.01, d_cutoff=0.001).drop("value"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({ORDERED}), f AS (
  SELECT "user", i, t, value AS x, 0 AS n, false AS held FROM e WHERE i = 1
  UNION ALL
  SELECT e."user", e.i, e.t, CASE WHEN f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005 THEN e.value ELSE f.x END,
    CASE WHEN f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005 THEN 0 ELSE f.n + 1 END, NOT (f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005)
  FROM f JOIN e ON e."user" = f."user" AND e.i = f.i + 1)
SELECT "user", t, {r('x', 'value_out')}, held AS is_held FROM f UNION ALL SELECT "user", t, NULL, false {UNSEEN}"""
)
def velocity_gate(spark, sf_dir):
    df = _observed(spark, sf_dir)
    return rounded(temporal.velocity_gate(df, ["user"], "t", ["value"], 0.005).drop("value"))


@query()
def predict_lost(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", "t", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rounded(temporal.predict_lost(df, ["user"], "t", ["value"], min_cutoff=0.0001, d_cutoff=0.001))


@query()
def spline_gap_fill(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", "t", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rounded(series.fill_blocks(df, ["user"], "t", ["value"], 10 * 86400.0), 4)


@query()
def butterworth_smoothing(spark, sf_dir):
    df = demo.points(spark, sf_dir).select("keypoint", F.col("frame").cast("double").alias("t"), "x", "y", "z")
    return rounded(series.smooth_blocks(df, ["keypoint"], "t", ["x", "y", "z"], 30.0, 6.0, block_samples=256), 4)


BONES = [(str(a), str(b), 300.0 + 10 * a) for a, b in ((12, 0), (0, 1), (1, 2), (12, 3), (3, 4), (4, 5))]


@query()
def rigid_skeleton(spark, sf_dir):
    """All frames are one recording, which is spread over blocks of frames."""
    return rounded(rigid.rigid_blocks(demo.points(spark, sf_dir).withColumn("recording", F.lit(0)), BONES, "12", ["recording"]), 4)


# Timing: a stage is an event type, a camera a user

@query(
    f"""WITH s AS (SELECT type AS stage, count(*) AS n, median(value) AS median, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
FROM ({demo.EVENTS_SQL}) GROUP BY 1) SELECT stage, n, {r('median', 'median')}, {r('mean', 'mean')}, {r('std', 'std')}, {r('q1', 'q1')}, {r('q3', 'q3')}, {r('100*median/(SELECT sum(median) FROM s)', 'pct')} FROM s"""
)
def stage_timing(spark, sf_dir):
    return rounded(stats.stage_timing(demo.events(spark, sf_dir).select(F.col("type").alias("stage"), F.col("value").alias("ms"))))


@query(f"SELECT stage, {r('max(m) - min(m)', 'spread')} FROM (SELECT type AS stage, \"user\", avg(value) AS m FROM ({demo.EVENTS_SQL}) GROUP BY 1, 2) GROUP BY 1")
def camera_spread(spark, sf_dir):
    df = demo.events(spark, sf_dir).select(F.col("type").alias("stage"), F.col("user").alias("camera_id"), F.col("value").alias("ms"))
    return rounded(stats.camera_spread(df))


INTERVALS = f'SELECT "user", 1000*(t - lag(t) OVER (PARTITION BY "user" ORDER BY t)) AS ms FROM ({demo.EVENTS_SQL})'


def _intervals(spark, sf_dir):
    df = windows.derivatives(demo.events(spark, sf_dir).withColumn("n", F.col("t")), "user", "t", [])
    from pyspark.sql import Window

    return df.select("user", (1000 * (F.col("t") - F.lag("t").over(Window.partitionBy("user").orderBy("t")))).alias("ms"))


@query(
    f"SELECT \"user\", count(ms) AS n, {r('avg(ms)', 'mean', 4)}, {r('median(ms)', 'median', 4)}, {r('min(ms)', 'min', 4)}, {r('max(ms)', 'max', 4)}, {r('stddev_pop(ms)', 'std', 3)}, "
    f"{r('stddev_pop(ms)/avg(ms)', 'cv')}, {r('1000/avg(ms)', 'fps', 9)} FROM ({INTERVALS}) GROUP BY 1"
)
def framerate_stats(spark, sf_dir):
    df = stats.framerate_stats(_intervals(spark, sf_dir), ("user",))
    digits = {"std": 3, "cv": 6, "fps": 9}
    return df.select("user", "n", *[(F.round(c, digits.get(c, 4)) + 0.0).alias(c) for c in df.columns[2:]])


@query(
    f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events), w AS (SELECT *, CASE WHEN hi - lo > 40 THEN ceil((hi - lo)/30) ELSE 1 END AS w FROM e)
SELECT (floor(value/w)*w)::DOUBLE AS bin_start, count(*) AS n, {r('count(*)::DOUBLE/any_value(w.n)', 'density')} FROM events, w GROUP BY 1"""
)
def value_histogram(spark, sf_dir):
    return rounded(stats.histogram(demo.events(spark, sf_dir), "value"))


@query(f"SELECT \"user\", rows, {r('span', 'duration_s', 3)}, {r('rows/span', 'fps')} FROM (SELECT \"user\", rows, d/CASE WHEN d > 1e15 THEN 1e9 WHEN d > 1e6 THEN 1e3 ELSE 1 END AS span FROM (SELECT \"user\", count(*) AS rows, max(t) - min(t) AS d FROM ({demo.EVENTS_SQL}) GROUP BY 1)) WHERE span > 0")
def recording_stats(spark, sf_dir):
    df = stats.recording_stats(demo.events(spark, sf_dir), "user", "t", "t").where("duration_s > 0")
    return df.select("user", "rows", (F.round("duration_s", 3) + 0.0).alias("duration_s"), (F.round("fps", 6) + 0.0).alias("fps"))


@query(f"SELECT CASE WHEN count(*) >= 10 AND median(value) BETWEEN 1 AND 1000 THEN {r('median(value)', 'x')[:-5]} END AS fps FROM events WHERE value > 0")
def median_frame_rate(spark, sf_dir):
    return rounded(stats.plausible_fps(demo.events(spark, sf_dir), "value"))


@query(f"SELECT \"user\", count(*) AS n_videos, count(DISTINCT n) = 1 AS synchronized FROM (SELECT \"user\", type, count(*) AS n FROM ({demo.EVENTS_SQL}) GROUP BY 1, 2) GROUP BY 1")
def video_sync(spark, sf_dir):
    counts = demo.events(spark, sf_dir).groupBy("user", "type").agg(F.count("*").alias("n"))
    return stats.in_sync(counts, "user", "n")


@query(f"SELECT type AS stage, count(*) FILTER (value > 50) AS present, count(*) AS total FROM ({demo.EVENTS_SQL}) GROUP BY 1")
def stage_completeness(spark, sf_dir):
    return stats.stage_completeness(demo.events(spark, sf_dir).select(F.col("type").alias("stage"), (F.col("value") > 50).alias("present")))


# Boards and calibrations

#: A board of 20 corners, of which frames leave out some and every fiftieth frame is missing.
BOARD = f"SELECT frame, keypoint::INT AS corner_id, x, y, z FROM ({demo.POINTS_SQL}) WHERE keypoint::INT < 20 AND frame % 50 <> 49"


def _corners(spark, sf_dir):
    return demo.points(spark, sf_dir).select("frame", F.col("keypoint").cast("int").alias("corner_id"), "x", "y", "z").where("corner_id < 20 and frame % 50 <> 49")


BOARD_ERRORS = f"""b AS ({BOARD}), e AS (SELECT a.frame, a.corner_id, c.corner_id AS corner_id2, sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) - 250 AS error
FROM b a JOIN b c ON a.frame = c.frame AND (c.corner_id = a.corner_id + 5 OR (c.corner_id = a.corner_id + 1 AND a.corner_id % 5 < 4)))"""


@query(f"WITH {BOARD_ERRORS} SELECT frame, corner_id, corner_id2, {r('error', 'error')} FROM e")
def board_errors(spark, sf_dir):
    return rounded(stats.board_errors(_corners(spark, sf_dir), 5, 250.0))


@query(
    f"WITH {BOARD_ERRORS} SELECT frame, count(*) AS n, {r('avg(error)', 'mean')}, {r('median(error)', 'median')}, {r('stddev_pop(error)', 'std')}, {r('avg(abs(error))', 'mean_abs')}, {r('max(abs(error))', 'max_abs')}, "
    f"{r('100*avg((abs(error) < 1)::INT::DOUBLE)', 'pct_within_1mm')}, {r('100*avg((abs(error) < 5)::INT::DOUBLE)', 'pct_within_5mm')} FROM e GROUP BY 1"
)
def board_health(spark, sf_dir):
    return rounded(stats.board_health(stats.board_errors(_corners(spark, sf_dir), 5, 250.0), ("frame",)))


@query(
    f"""WITH b AS ({BOARD}), m AS (SELECT a.frame, sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) AS d FROM b a JOIN b c ON a.corner_id = c.corner_id AND c.frame = a.frame + 1)
SELECT f.frame, round(CASE WHEN n >= 3 THEN d ELSE 'infinity'::DOUBLE END, 6) + 0.0 AS motion FROM (SELECT DISTINCT frame FROM b) f
LEFT JOIN (SELECT frame, median(d) AS d, count(*) AS n FROM m GROUP BY 1) m USING (frame) WHERE f.frame < (SELECT max(frame) FROM b)"""
)
def board_motion(spark, sf_dir):
    return rounded(windows.board_motion(_corners(spark, sf_dir)))


@query(f"SELECT corner_id, {r('median(x)', 'x')}, {r('median(y)', 'y')}, {r('median(z)', 'z')} FROM ({BOARD}) GROUP BY 1")
def corner_medians(spark, sf_dir):
    return rounded(windows.corner_medians(_corners(spark, sf_dir)))


CUSTOMER_CAMERAS = "SELECT 'cam' || c_custkey AS camera_id, 400 + c_acctbal::DOUBLE/4 AS fx, 410 + c_acctbal::DOUBLE/4 AS fy, 320 + c_nationkey*8.0::DOUBLE AS cx, 240 + c_nationkey*2.0::DOUBLE AS cy, c_nationkey AS n FROM customer"


def _customer_cameras(spark, sf_dir):
    """A camera a customer: focal lengths from the balance, the centre from the nation."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    focal, n = F.col("c_acctbal").cast("double") / 4, F.col("c_nationkey")
    return df.select(F.concat(F.lit("cam"), "c_custkey").alias("camera_id"), (400 + focal).alias("fx"), (410 + focal).alias("fy"), (320 + n * 8.0).alias("cx"), (240 + n * 2.0).alias("cy"), n.alias("n"))


@query(f"SELECT camera_id, fx > 320 AND fx < 1920 AS focal_ok, abs(cx - 320)/640 < 0.25 AS center_ok, {r('fx/fy', 'aspect')} FROM ({CUSTOMER_CAMERAS}) WHERE fy <> 0")
def camera_sanity(spark, sf_dir):
    cameras = _customer_cameras(spark, sf_dir).where("fy <> 0")
    return rounded(stats.camera_sanity(cameras.withColumns({"width": F.lit(640), "height": F.lit(480)})))


def _two_calibrations(spark, sf_dir):
    """Each camera, and a copy with a nation's own changes that is turned about its axis."""
    turn = F.radians(F.col("n").cast("double") * 7)
    zero, one = F.lit(0.0), F.lit(1.0)
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    a = _customer_cameras(spark, sf_dir).withColumns({c: zero for c in ("px", "py", "pz")} | dict(zip(names, [one, zero, zero, zero, one, zero, zero, zero, one], strict=True)))
    b = a.withColumns({"fx": F.col("fx") + F.col("n"), "cy": F.col("cy") - 2 * F.col("n"), "px": F.col("n") * 3.0, "pz": F.col("n") * 4.0, "r00": F.cos(turn), "r01": -F.sin(turn), "r10": F.sin(turn), "r11": F.cos(turn)})
    return a, b


@query(f"SELECT camera_id, {r('n', 'focal_delta')}, {r('2*n', 'center_delta')}, {r('5*n', 'position_delta')}, {r('7*n', 'angle')} FROM ({CUSTOMER_CAMERAS})".replace("round(n, 6)", "round(n::DOUBLE, 6)").replace("round(2*n, 6)", "round(2.0::DOUBLE*n, 6)").replace("round(5*n, 6)", "round(5.0::DOUBLE*n, 6)").replace("round(7*n, 6)", "round(7.0::DOUBLE*n, 6)"))
def calibration_deltas(spark, sf_dir):
    return rounded(calibration.compare(*_two_calibrations(spark, sf_dir)))


@query(f"SELECT count(*) AS n_cameras, {r('avg(n::DOUBLE)', 'mean_focal')}, max(n)::DOUBLE AS max_focal, {r('avg(5.0::DOUBLE*n)', 'mean_position')}, max(5*n)::DOUBLE AS max_position, {r('avg(7.0::DOUBLE*n)', 'mean_angle')}, {r('max(7.0::DOUBLE*n)', 'max_angle')} FROM ({CUSTOMER_CAMERAS})")
def calibration_summary(spark, sf_dir):
    told = calibration.summary(calibration.compare(*_two_calibrations(spark, sf_dir)))
    return rounded(told.select("n_cameras", "mean_focal", "max_focal", "mean_position", "max_position", "mean_angle", "max_angle"))


@query()
def kabsch_fit(spark, sf_dir):
    """Per label: the rotation and shift that take the points to themselves turned by (0.1, 0.2, 0.3) and moved."""
    df = demo.points(spark, sf_dir)
    x2, y2, z2 = cam.rotate(F.col("x"), F.col("y"), F.col("z"), F.lit(0.1), F.lit(0.2), F.lit(0.3))
    sums = calibration.kabsch_sums(df.withColumns({"x2": x2 + 10, "y2": y2 - 20, "z2": z2 + 30}), ("label",))
    rows = []
    for row in sums.collect():  # a row per rig
        turn, shift = calibration.kabsch(row)
        rows.append((row["label"], *np.round(np.concatenate((calibration.rotation_vector(turn), shift)), 6).tolist()))
    return spark.createDataFrame(rows, "label int, rx double, ry double, rz double, tx double, ty double, tz double")


@query()
def camera_tree(spark, sf_dir):
    counts = [(c["cam_a"], c["cam_b"], float(c["n_shared"])) for c in align.shared_counts(_obs(spark, sf_dir)).collect()]  # pairs of a rig
    return spark.createDataFrame(calibration.spanning_tree(counts), "cam_a string, cam_b string, n_shared double")


# Mass and balance

COMS = "coms AS (SELECT frame, segment, mass, px + (dx-px)*com AS x, py + (dy-py)*com AS y, pz + (dz-pz)*com AS z FROM lengths WHERE (frame % 5 <> 0 OR segment NOT IN ('left_foot', 'left_shank')) AND (frame % 7 <> 0 OR segment NOT IN ('right_forearm', 'right_upper_arm')))"


def _coms(spark, sf_dir):
    segs = demo.segments(spark)
    pts = demo.points(spark, sf_dir).select("frame", "keypoint", "x", "y", "z")
    end = lambda p, k: pts.select("frame", F.col("keypoint").alias(k), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    ends = end("p", "proximal").join(F.broadcast(segs.select("segment", "proximal", "distal")), "proximal").join(end("d", "distal"), ["frame", "distal"])
    coms = kinematics.segment_com(ends, segs)
    lost = ((F.col("frame") % 5 == 0) & F.col("segment").isin("left_foot", "left_shank")) | (
        (F.col("frame") % 7 == 0) & F.col("segment").isin("right_forearm", "right_upper_arm")
    )
    return coms.where(~lost)


@query(f"WITH {LENGTHS}, {COMS} SELECT frame, segment, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM coms")
def segment_com(spark, sf_dir):
    return rounded(_coms(spark, sf_dir))


BODY = f"""{LENGTHS}, {COMS}, moved AS (SELECT c.*, c.mass
    + CASE WHEN frame % 5 = 0 AND segment = 'left_thigh' THEN 0.013 + 0.046 ELSE 0 END
    + CASE WHEN frame % 7 = 0 AND segment = 'spine' THEN 0.022 + 0.027 ELSE 0 END AS w FROM coms c),
body AS (SELECT frame, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z, sum(mass) AS observed FROM moved GROUP BY frame)"""


def _body(spark, sf_dir):
    return kinematics.center_of_mass(_coms(spark, sf_dir), demo.segments(spark))


@query(
    f"WITH {BODY} SELECT frame, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('observed', 'observed_mass')}, CASE WHEN observed >= 0.9 THEN 3 WHEN observed >= 0.7 THEN 2 WHEN observed >= 0.5 THEN 1 ELSE 0 END AS confidence FROM body"
)
def center_of_mass(spark, sf_dir):
    return rounded(_body(spark, sf_dir))


BALANCE = f"""WITH {BODY}, b AS (SELECT frame, label, x, y, z, frame/30.0 AS t FROM body JOIN (SELECT vec_id AS frame, label FROM embeddings) USING (frame)),
l AS (SELECT *, t - lag(t) OVER w AS dt, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM b WINDOW w AS (PARTITION BY label ORDER BY t))"""


def _balance(spark, sf_dir):
    labels = demo.embeddings(spark, sf_dir).select(F.col("vec_id").alias("frame"), "label")
    return _body(spark, sf_dir).join(labels, "frame").withColumn("t", F.col("frame") / 30.0)


@query(f"{BALANCE} SELECT frame, {r('x + (x - x0)/dt/sqrt(9810/z)', 'xcom_x', 4)}, {r('y + (y - y0)/dt/sqrt(9810/z)', 'xcom_y', 4)} FROM l")
def xcom(spark, sf_dir):
    return rounded(kinematics.xcom(_balance(spark, sf_dir), "label", "t").select("frame", "xcom_x", "xcom_y"), 4)


@query(f"WITH {BODY} SELECT frame, {r('x', 'cop_x', 4)}, {r('y', 'cop_y', 4)}, {r('x - 100/(9810+200)*z', 'cmp_x', 4)}, {r('y - 50/(9810+200)*z', 'cmp_y', 4)} FROM body".replace("100/(9810+200)", "100.0::DOUBLE/10010").replace("50/(9810+200)", "50.0::DOUBLE/10010"))
def cop_cmp(spark, sf_dir):
    x, y = kinematics.cmp_xy(F.lit(100.0), F.lit(50.0), F.lit(200.0))
    return rounded(_body(spark, sf_dir).select("frame", F.col("x").alias("cop_x"), F.col("y").alias("cop_y"), x.alias("cmp_x"), y.alias("cmp_y")), 4)


INERTIA = f"""WITH {BODY}, d AS (SELECT c.frame, c.mass AS m, c.x - b.x AS dx, c.y - b.y AS dy, c.z - b.z AS dz FROM coms c JOIN body b USING (frame)),
i AS (SELECT frame, sum(m*(dy*dy+dz*dz)) AS ixx, sum(m*(dx*dx+dz*dz)) AS iyy, sum(m*(dx*dx+dy*dy)) AS izz, sum(-m*dx*dy) AS ixy, sum(-m*dx*dz) AS ixz, sum(-m*dy*dz) AS iyz, sum(m) AS mass FROM d GROUP BY 1)"""


def _inertia(spark, sf_dir):
    coms = _coms(spark, sf_dir).join(F.broadcast(demo.segments(spark).select("segment", "mass")), "segment")
    centre = _body(spark, sf_dir).select("frame", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return kinematics.inertia(coms.join(centre, "frame"))


@query(f"{INERTIA} SELECT frame, {', '.join(r(c, c, 3) for c in ('ixx', 'iyy', 'izz', 'ixy', 'ixz', 'iyz', 'mass'))} FROM i")
def inertia(spark, sf_dir):
    return rounded(_inertia(spark, sf_dir), 3)


@query(f"{INERTIA} SELECT frame, {r('ixx+iyy+izz', 'trace', 2)}, {r('cbrt(ixx*(iyy*izz-iyz*iyz) - ixy*(ixy*izz-iyz*ixz) + ixz*(ixy*iyz-iyy*ixz))', 'mean', 2)}, {r('sqrt(ixx*ixx+iyy*iyy+izz*izz+2*(ixy*ixy+ixz*ixz+iyz*iyz))', 'size', 2)} FROM i")
def principal_trace(spark, sf_dir):
    """Sum, product (its cube root) and sum of squares (its root) of the principal moments: the three invariants of the tensor."""
    df = kinematics.principal_moments(_inertia(spark, sf_dir))
    i1, i2, i3 = F.col("i1"), F.col("i2"), F.col("i3")
    return rounded(df.select("frame", (i1 + i2 + i3).alias("trace"), F.cbrt(i1 * i2 * i3).alias("mean"), F.sqrt(i1 * i1 + i2 * i2 + i3 * i3).alias("size")), 2)


PRINCIPAL = f"""{INERTIA}, q AS (SELECT *, (ixx+iyy+izz)/3 AS q, sqrt(((ixx-(ixx+iyy+izz)/3)**2 + (iyy-(ixx+iyy+izz)/3)**2 + (izz-(ixx+iyy+izz)/3)**2 + 2*(ixy*ixy+ixz*ixz+iyz*iyz))/6) AS p FROM i),
d AS (SELECT *, acos(greatest(-1, least(1, ((ixx-q)*((iyy-q)*(izz-q)-iyz*iyz) - ixy*(ixy*(izz-q)-iyz*ixz) + ixz*(ixy*iyz-(iyy-q)*ixz))/(2*p*p*p))))/3 AS phi FROM q),
e AS (SELECT frame, mass, q + 2*p*cos(phi + 2*pi()/3) AS i1, q + 2*p*cos(phi - 2*pi()/3) AS i2, q + 2*p*cos(phi) AS i3 FROM d)"""


@query(f"{PRINCIPAL.replace('d AS (SELECT *, acos', 'd2 AS (SELECT *, acos').replace('FROM d)', 'FROM d2)')} SELECT frame, " + ", ".join([*(r(c, c, 2) for c in ("i1", "i2", "i3")), *(r(f"sqrt(greatest({a}+{b}-{c}, 0)*5/(2*mass))", f"s{n}", 3) for n, (c, a, b) in enumerate((("i1", "i2", "i3"), ("i2", "i1", "i3"), ("i3", "i1", "i2")), 1))]) + " FROM e")
def equimomental_ellipsoid(spark, sf_dir):
    df = kinematics.ellipsoid(kinematics.principal_moments(_inertia(spark, sf_dir)))
    return df.select("frame", *[(F.round(c, 2 if c[0] == "i" else 3) + 0.0).alias(c) for c in ("i1", "i2", "i3", "s1", "s2", "s3")])


@query(
    "SELECT segment, round((fm+mm)/2, 6) + 0.0 AS mass, round((fc+mc)/2, 6) + 0.0 AS com FROM "
    + demo.values_sql([(f[0], f[1], m[1], f[2], m[2]) for f, m in zip(kinematics.DE_LEVA_FEMALE, kinematics.DE_LEVA_MALE, strict=True)], ["segment", "fm", "mm", "fc", "mc"])
)
def inertial_parameters(spark, sf_dir):
    return rounded(kinematics.inertial_parameters(spark).select("segment", "mass", "com"))


# Shapes of tables and names

WIDE = ["0", "1", "2"]


@query("SELECT frame, " + ", ".join(f"max(round({c}, 6)) FILTER (keypoint = '{n}') + 0.0 AS \"{n}_{c}\"" for n in WIDE for c in "xyz") + f" FROM ({demo.POINTS_SQL}) GROUP BY 1")
def long_to_wide(spark, sf_dir):
    return rounded(files.long_to_wide(demo.points(spark, sf_dir), WIDE))


@query(f"SELECT frame, keypoint, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM ({demo.POINTS_SQL}) WHERE keypoint IN ('0', '1', '2')")
def wide_to_long(spark, sf_dir):
    return rounded(files.wide_to_long(files.long_to_wide(demo.points(spark, sf_dir), WIDE)))


@query(
    f"""WITH p AS ({demo.POINTS_SQL}), n AS (SELECT k::VARCHAR AS keypoint, k::INT AS ord FROM range(23) AS t(k))
SELECT f.frame, n.keypoint, n.ord, {r('p.x', 'x')}, CASE WHEN p.x IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS visibility FROM (SELECT DISTINCT frame FROM p) f, n LEFT JOIN p ON p.frame = f.frame AND p.keypoint = n.keypoint"""
)
def densify(spark, sf_dir):
    schema = spark.range(23).select(F.col("id").cast("string").alias("keypoint"), F.col("id").cast("int").alias("ord"))
    pts = demo.points(spark, sf_dir)
    return rounded(gates.densify(pts, schema, pts).select("frame", "keypoint", "ord", "x", "visibility"))


@query(f"SELECT frame, 'center' AS keypoint, {r('sum(x)/2', 'x')}, {r('sum(y)/2', 'y')}, {r('sum(z)/2', 'z')} FROM ({demo.POINTS_SQL}) WHERE keypoint IN ('6', '9') GROUP BY 1")
def canonical_mapping(spark, sf_dir):
    mapping = spark.createDataFrame([("6", "center", 0.5), ("9", "center", 0.5)], "tracker string, canonical string, weight double")
    return rounded(gates.canonical(demo.points(spark, sf_dir), mapping))


@query(f"SELECT frame, keypoint, {r('CASE WHEN frame % 2 = 0 THEN -x ELSE x END', 'x')} FROM ({demo.POINTS_SQL})")
def merged_layers(spark, sf_dir):
    pts = demo.points(spark, sf_dir).select("frame", "keypoint", "x")
    return rounded(gates.merge(pts, pts.withColumn("x", F.when(F.col("frame") % 2 == 0, -F.col("x")))))


@query(f"SELECT frame, keypoint, {r('x', 'x')}, {r('z', 'y')}, {r('-y', 'z')} FROM ({demo.POINTS_SQL})")
def quarter_turn(spark, sf_dir):
    return rounded(cam.quarter_turn_x(demo.points(spark, sf_dir)).select("frame", "keypoint", "x", "y", "z"))


@query(f"SELECT frame + 1 AS frame, keypoint, {r('x*0.001', 'x', 9)}, {r('-z*0.001', 'y', 9)}, {r('-y*0.001', 'z', 9)} FROM ({demo.POINTS_SQL})")
def animation_points(spark, sf_dir):
    return rounded(files.blender_points(demo.points(spark, sf_dir).withColumn("trajectory", F.lit("3d_xyz"))), 9)


NAMED = "(SELECT segment AS name FROM " + demo.SEGMENTS_SQL + " UNION ALL SELECT 'cam_' || c_custkey || '.left_hand' FROM customer)"


@query(
    f"""SELECT name, CASE WHEN name LIKE '%left%' THEN 'left' WHEN name LIKE '%right%' THEN 'right' ELSE 'center' END AS side,
CASE WHEN name LIKE '%hand%' THEN 'hand' WHEN name LIKE '%face%' THEN 'face' ELSE 'body' END AS part, regexp_replace(name, '^[^.]*\\.', '') AS plain,
TRY_CAST(nullif(regexp_extract(name, '(?:camera|cam)[._-]?(\\d+)', 1), '') AS INT) AS camera FROM {NAMED}"""
)
def name_classes(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("cam_"), "c_custkey", F.lit(".left_hand")).alias("name"))
    n = F.col("name")
    df = demo.segments(spark).select(F.col("segment").alias("name")).unionByName(customers)
    return df.select("name", names.side(n).alias("side"), names.part(n).alias("part"), names.strip_stage(n).alias("plain"), names.camera_index(n).alias("camera"))


# Streams, replayed to their end

def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query(
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(value) AS n, " + f"{r('avg(value)', 'mean')}, {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM events GROUP BY 1, 2"
)
def stream_windows(spark, sf_dir):
    """The batch form of the windowed report; a live stream gives the same rows once its watermark has passed them."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    told = rounded(live.tumbling(df, "1 hour", ("event_type",)))
    return told.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """SELECT c.event_id, s.event_id AS skel_event_id FROM events c LEFT JOIN events s ON s.user_id = c.user_id AND s.event_type = 'click'
AND s.ts BETWEEN c.ts - INTERVAL 2 hour AND c.ts + INTERVAL 2 hour WHERE c.event_type = 'error'"""
)
def stream_frame_join(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    joined = live.join_frames(df.where("event_type = 'error'"), df.where("event_type = 'click'"), wait="2 hours")
    return joined.select("event_id", "skel_event_id")


# Rigs, boards and views

@query("SELECT ord::INT AS ord, 'cam' || n_nationkey AS camera_id, n_regionkey FROM nation JOIN (VALUES (0, 7), (1, 2), (2, 21)) AS v(ord, k) ON v.k = n_nationkey")
def camera_subset(spark, sf_dir):
    """Three of a rig whose cameras are nations, in the order asked for."""
    rig = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("camera_id", F.concat(F.lit("cam"), "n_nationkey"))
    return triangulate.rig_subset(rig, ["cam7", "cam2", "cam21"]).select("ord", "camera_id", "n_regionkey")


@query(f"SELECT frame, keypoint, {r('x', 'x', 3)}, {r('y', 'y', 3)}, {r('z', 'z', 3)} FROM ({demo.POINTS_SQL})")
def triangulate_pixels(spark, sf_dir):
    df = _projected(spark, sf_dir).withColumns({"u": F.col("fx") * F.col("a") + F.col("cx"), "v": F.col("fy") * F.col("b") + F.col("cy")})
    return rounded(triangulate.triangulate_pixels(df.select("frame", "keypoint", "camera_id", "u", "v"), demo.cameras(spark)), 3)


@query(f"SELECT frame, keypoint, {r('x', 'x', 3)}, {r('y', 'y', 3)}, {r('z', 'z', 3)}, CASE WHEN frame % 2 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS w2 FROM ({demo.POINTS_SQL})")
def triangulate_outlier(spark, sf_dir):
    """One camera of four is off by half a unit in every second frame: the ensemble of three and more must find the points without it."""
    off = F.when(F.col("frame") % 2 == 1, 0.5).otherwise(0.0)
    df = _projected(spark, sf_dir).withColumn("un", F.col("a") + F.when(F.col("camera_id") == "cam2", off).otherwise(0.0))
    found = triangulate.triangulate(df.select("frame", "keypoint", "camera_id", "un", F.col("b").alias("vn")), demo.cameras(spark), triangulate.Rejection(min_cameras=3, decay=50.0))
    return rounded(found.select("frame", "keypoint", "x", "y", "z", F.element_at("weights", "cam2").alias("w2")), 3)


@query(f"SELECT frame, keypoint, camera_id, {r('fx*a + cx - u', 'du')}, {r('fy*b + cy - v', 'dv')} FROM ({demo.PROJECTED_SQL})")
def signed_reprojection(spark, sf_dir):
    """What a lens without distortion would see, against the projection."""
    df = _projected(spark, sf_dir)
    du, dv = cam.signed_error(F.col("fx") * F.col("a") + F.col("cx"), F.col("fy") * F.col("b") + F.col("cy"), F.col("u"), F.col("v"))
    return rounded(df.select("frame", "keypoint", "camera_id", du.alias("du"), dv.alias("dv")))


VIEWS = f"SELECT frame, camera_id, keypoint::INT AS corner_id, x FROM ({demo.SEEN_SQL}) WHERE visibility >= 0.7 AND keypoint::INT < 20"


def _views(spark, sf_dir):
    return demo.seen(spark, sf_dir).where("visibility >= 0.7").select("frame", "camera_id", F.col("keypoint").cast("int").alias("corner_id"), "x").where("corner_id < 20")


@query(
    f"""WITH v AS ({VIEWS}), k AS (SELECT v.* FROM v JOIN (SELECT frame, camera_id FROM v GROUP BY ALL HAVING count(*) >= 6) USING (frame, camera_id))
SELECT frame, camera_id, corner_id FROM k JOIN (SELECT frame, corner_id FROM k GROUP BY ALL HAVING count(DISTINCT camera_id) >= 2) USING (frame, corner_id)"""
)
def adjustment_points(spark, sf_dir):
    return align.adjustment_points(_views(spark, sf_dir)).select("frame", "camera_id", "corner_id")


@query(
    f"""WITH v AS (SELECT frame // 10 AS frame, frame % 10 AS recording, camera_id, corner_id FROM ({VIEWS})), k AS (SELECT v.* FROM v JOIN (SELECT recording, frame, camera_id FROM v GROUP BY ALL HAVING count(*) >= 6) USING (recording, frame, camera_id))
SELECT recording, frame, camera_id, corner_id FROM k JOIN (SELECT recording, frame, corner_id FROM k GROUP BY ALL HAVING count(DISTINCT camera_id) >= 2) USING (recording, frame, corner_id)"""
)
def adjustment_points_of_recordings(spark, sf_dir):
    views = _views(spark, sf_dir).select(F.floor(F.col("frame") / 10).alias("frame"), (F.col("frame") % 10).alias("recording"), "camera_id", "corner_id")
    return align.adjustment_points(views, by=("recording",)).select("recording", "frame", "camera_id", "corner_id")


def _board(spark):
    return spark.range(20).select(F.col("id").cast("int").alias("corner_id"), ((F.col("id") % 5) * 40.0).alias("bx"), (F.floor(F.col("id") / 5) * 40.0).alias("by"))


@query(f"WITH v AS ({VIEWS}) SELECT g.frame, g.camera_id, c.k::INT AS corner_id, {r('v.x', 'x')} FROM (SELECT DISTINCT frame, camera_id FROM v) g CROSS JOIN range(20) AS c(k) LEFT JOIN v ON v.frame = g.frame AND v.camera_id = g.camera_id AND v.corner_id = c.k")
def all_corners(spark, sf_dir):
    return rounded(align.all_corners(_views(spark, sf_dir), _board(spark), ["frame", "camera_id"]).select("frame", "camera_id", "corner_id", "x"))


@query(f"SELECT frame, camera_id, corner_id, (corner_id % 5)*40.0::DOUBLE AS bx, (corner_id // 5)*40.0::DOUBLE AS by FROM ({VIEWS})")
def corners_on_board(spark, sf_dir):
    return align.on_board(_views(spark, sf_dir), _board(spark)).select("frame", "camera_id", "corner_id", "bx", F.col("by").cast("double").alias("by"))


@query(f"SELECT DISTINCT type, dense_rank() OVER (ORDER BY type) - 1 AS id FROM ({demo.EVENTS_SQL})")
def dense_ids(spark, sf_dir):
    return align.dense_ids(demo.events(spark, sf_dir), "type", "id").select("type", "id").distinct()


@query("SELECT 'rec_cam' || c_custkey % 6 || '_' || c_custkey || '.npy' AS data_key, 'cam' || c_custkey % 6 AS camera_id FROM customer WHERE c_custkey % 6 < 4")
def camera_by_part(spark, sf_dir):
    """Arrays named after cameras; two of six cameras are not in the calibration."""
    n = F.col("c_custkey") % 6
    data = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("rec_cam"), n, F.lit("_"), "c_custkey", F.lit(".npy")).alias("data_key"))
    return align.match_by_part(data, demo.cameras(spark))


@query(f"SELECT label, frame, segment, {r('length', 'length')} FROM (WITH {LENGTHS} SELECT * FROM lengths) JOIN (SELECT vec_id AS frame, label FROM embeddings) USING (frame)")
def recording_lengths(spark, sf_dir):
    """Two keys of a frame: labels stand for recordings."""
    return rounded(stats.segment_lengths(demo.points(spark, sf_dir), demo.segments(spark), ("label", "frame")).drop("pair"))


# Times, groups and lists

@query(f'SELECT "user", type, t FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY "user") AS n FROM ({demo.EVENTS_SQL}) WINDOW w AS (PARTITION BY "user" ORDER BY value, t)) WHERE k <= greatest(n // 2, 3)')
def best_half(spark, sf_dir):
    return stats.best_half(demo.events(spark, sf_dir), ["user"], ["value", "t"]).select("user", "type", "t")


@query(f'SELECT "user", type, n FROM (SELECT "user", type, count(*) AS n, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, type) AS k FROM ({demo.EVENTS_SQL}) GROUP BY 1, 2) WHERE k = 1')
def largest_group(spark, sf_dir):
    return stats.largest_group(demo.events(spark, sf_dir), ["user"], "type")


@query(f'SELECT "user", count(*) FILTER (value > 50) AS detected, 20::BIGINT AS total FROM ({demo.EVENTS_SQL}) GROUP BY 1')
def detection_counts(spark, sf_dir):
    return stats.detection_counts(demo.events(spark, sf_dir).withColumn("x", F.when(F.col("value") > 50, F.col("value"))), ["user"], 20)


@query(f'SELECT "user", min(f) AS first_frame, max(f) AS last_frame, count(DISTINCT f) AS n_frames FROM (SELECT "user", floor(t*30)::BIGINT AS f FROM ({demo.EVENTS_SQL})) GROUP BY 1')
def frame_range(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", align.frame_at(F.col("t"), 30.0).alias("frame"))
    return stats.frame_range(df, ["user"])


SPANS = f'SELECT "user", min(t) + 1000 AS start, CASE WHEN "user" % 2 = 0 THEN min(t) + 500000 END AS stop FROM ({demo.EVENTS_SQL}) GROUP BY 1'


@query(f'SELECT e."user", e.t FROM ({demo.EVENTS_SQL}) e JOIN ({SPANS}) s ON e."user" = s."user" AND e.t >= s.start AND (s.stop IS NULL OR e.t < s.stop)')
def captured_frames(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("user", "t")
    spans = df.groupBy("user").agg((F.min("t") + 1000).alias("start"), F.when(F.col("user") % 2 == 0, F.min("t") + 500000).alias("stop"))
    return align.captured(df, spans, ["user"]).select("user", "t")


@query("SELECT vec_id AS frame FROM embeddings WHERE vec_id % 10 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 15 = 0")
def sampled_frames(spark, sf_dir):
    frames = demo.embeddings(spark, sf_dir).select(F.col("vec_id").alias("frame"))
    return align.sampled(frames.where("frame % 10 = 0"), frames.where("frame % 15 = 0"))


@query(
    f"""WITH RECURSIVE c AS (SELECT *, t - lag(t) OVER (PARTITION BY "user" ORDER BY t) AS dt, row_number() OVER (PARTITION BY "user", type ORDER BY t) AS i FROM ({demo.EVENTS_SQL})),
e AS MATERIALIZED (SELECT * FROM c), f AS (
  SELECT "user", type, i, t, value AS x, 0 AS n, false AS held FROM e WHERE i = 1
  UNION ALL
  SELECT e."user", e.type, e.i, e.t, CASE WHEN f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005 THEN e.value ELSE f.x END,
    CASE WHEN f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005 THEN 0 ELSE f.n + 1 END, NOT (f.n >= 5 OR abs(e.value - f.x)/e.dt <= 0.005)
  FROM f JOIN e ON e."user" = f."user" AND e.type = f.type AND e.i = f.i + 1)
SELECT "user", type, t, {r('x', 'value_out')}, held AS is_held FROM f"""
)
def velocity_gate_clock(spark, sf_dir):
    """Types stand for keypoints of a user's recording: all of its rows are the frame clock, whatever they hold."""
    df = demo.events(spark, sf_dir).select("user", "type", "t", "value")
    return rounded(temporal.velocity_gate(df, ["user", "type"], "t", ["value"], 0.005, recording=["user"]).drop("value"))


# Names, layers and displays

@query(f"SELECT frame, 't6' AS keypoint, {r('x', 'x')} FROM ({demo.POINTS_SQL}) WHERE keypoint = '6'")
def tracker_names(spark, sf_dir):
    mapping = spark.createDataFrame([("t6", "left_hand", 1.0), ("t9", "center", 0.5), ("t10", "center", 0.5)], "tracker string, canonical string, weight double")
    named = F.when(F.col("keypoint") == "6", "left_hand").when(F.col("keypoint") == "9", "center")
    pts = demo.points(spark, sf_dir).select("frame", named.alias("keypoint"), "x").where("keypoint is not null")
    return rounded(gates.tracker_names(pts, mapping))


@query(f"SELECT frame, CASE k WHEN 1 THEN 'brow' WHEN 2 THEN 'nose' ELSE 'chin' END AS keypoint, {r('x', 'x')} FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY keypoint::INT) AS k FROM ({demo.POINTS_SQL}) WHERE keypoint::INT % 2 = 1) WHERE k <= 3")
def renamed_by_rank(spark, sf_dir):
    pts = demo.points(spark, sf_dir).withColumn("index", F.col("keypoint").cast("int")).where("index % 2 = 1")
    return rounded(gates.renamed_by_rank(pts, ["brow", "nose", "chin"]).select("frame", "keypoint", "x"))


@query(f"SELECT frame, keypoint, {r('CASE WHEN frame % 2 = 0 THEN x + 1 ELSE x END', 'x')} FROM ({demo.POINTS_SQL})")
def gate_over_filter(spark, sf_dir):
    pts = demo.points(spark, sf_dir).select("frame", "keypoint", "x")
    return rounded(gates.gate_over_filter(pts, pts.withColumn("x", F.when(F.col("frame") % 2 == 0, F.col("x") + 1)), enabled=True))


@query(f"SELECT event_id, {r('value - 50', 'width')}, {r('60 - value', 'height')} FROM events WHERE value > 50 AND value < 60")
def with_area(spark, sf_dir):
    df = demo.events(spark, sf_dir).select("event_id", (F.col("value") - 50).alias("width"), (60 - F.col("value")).alias("height"))
    return rounded(gates.with_area(df))


@query("SELECT event_id, ['TRACE', 'DEBUG', 'INFO', 'WARNING', 'ERROR', 'NONE'][event_id % 6 + 1] AS level FROM events WHERE event_id % 6 IN (3, 4)")
def log_level(spark, sf_dir):
    names_ = F.array(*map(F.lit, ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "NONE")))
    df = demo.events(spark, sf_dir).select("event_id", F.get(names_, (F.col("event_id") % 6).cast("int")).alias("level"))
    return gates.at_least(df, "WARNING")


@query(f"SELECT frame, count(*)::INT AS n, {r('min(x)/2', 'left')}, {r('max(x)/2', 'right')}, {r('min(y)/4', 'top')}, {r('max(y)/4', 'bottom')} FROM ({demo.POINTS_SQL}) WHERE keypoint <> '3' GROUP BY 1".replace('AS left', 'AS "left"').replace('AS right', 'AS "right"'))
def overlay_boxes(spark, sf_dir):
    pts = demo.points(spark, sf_dir).withColumn("x", F.when(F.col("keypoint") != "3", F.col("x")))
    return rounded(gates.overlay(pts, 0.5, 0.25).select("frame", F.size("points").alias("n"), "left", "right", "top", "bottom"))


@query(f"SELECT label, segment, {r('ratio*height', 'length')} FROM {demo.SEGMENTS_SQL} s, (SELECT label, max(z) AS height FROM ({demo.POINTS_SQL}) GROUP BY 1) h")
def segment_seeds(spark, sf_dir):
    """Seeds of each recording's body; its height is the largest that was measured."""
    heights = demo.points(spark, sf_dir).groupBy("label").agg(F.max("z").alias("height"))
    return rounded(kinematics.body_seeds(demo.segments(spark), heights, ["label"]))


@query(f"""WITH f AS (SELECT "user", t, row_number() OVER (PARTITION BY "user" ORDER BY t DESC) AS k, 1000*(t - lag(t) OVER (PARTITION BY "user" ORDER BY t)) AS ms FROM ({demo.EVENTS_SQL}))
SELECT "user", count(ms) AS n, {r('avg(ms)', 'mean', 4)}, {r('max(ms)', 'max', 4)} FROM f WHERE k <= 20 GROUP BY 1""")
def framerate_last(spark, sf_dir):
    """Frame rates over the last 20 intervals of each camera."""
    df = demo.events(spark, sf_dir)
    from pyspark.sql import Window

    rows = df.select("user", "t", (1000 * (F.col("t") - F.lag("t").over(Window.partitionBy("user").orderBy("t")))).alias("ms"))
    return rounded(stats.framerate_window(rows, ("user",), "t", 20).select("user", "n", "mean", "max"), 4)


@query(f"SELECT frame, keypoint::INT AS point, {r('CASE WHEN visibility > 0 THEN x END', 'x')} FROM ({demo.SEEN_SQL}) WHERE camera_id = 'cam1' AND keypoint::INT < 10")
def stage_points(spark, sf_dir):
    """The first ten points of a camera's stage; those with visibility 0 are null."""
    seen = demo.seen(spark, sf_dir).where("camera_id = 'cam1'").withColumn("point", F.col("keypoint").cast("int"))
    return rounded(gates.stage_points(seen, 10).select("frame", "point", "x"))


@query(f"WITH {INERTIA} SELECT frame, {r('ixx', 'ixx', 2)}, {r('ixy', 'ixy', 2)}, {r('iyz', 'iyz', 2)}, 1.0::DOUBLE AS handed FROM i".replace("WITH WITH", "WITH"))
def principal_axes(spark, sf_dir):
    """The tensor put together again from its moments and axes, which are right-handed."""
    df = kinematics.principal_axes(_inertia(spark, sf_dir))
    back = lambda a, b: sum((F.col(f"i{k}") * F.col(f"a{k}{a}") * F.col(f"a{k}{b}") for k in (2, 3)), F.col("i1") * F.col(f"a1{a}") * F.col(f"a1{b}"))
    a, b, c = ([F.col(f"a{k}{x}") for x in "xyz"] for k in (1, 2, 3))
    handed = (a[1] * b[2] - a[2] * b[1]) * c[0] + (a[2] * b[0] - a[0] * b[2]) * c[1] + (a[0] * b[1] - a[1] * b[0]) * c[2]
    return rounded(df.select("frame", back("x", "x").alias("ixx"), back("x", "y").alias("ixy"), back("y", "z").alias("iyz"), handed.alias("handed")), 2)


from . import long_queries  # noqa: E402, F401  registers its queries
