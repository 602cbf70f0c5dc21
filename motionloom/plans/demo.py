"""The tables of the test data seen as motion data: keypoints, cameras, observations, timed samples.

embeddings: a row is a frame, floats 3k to 3k+2 are keypoint k in mm (scaled, standing 1.5 m up). events: a user is a
keypoint or camera, an event type a camera or stage. Cameras are four constants around the origin.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYPOINTS = 21
#: segment, pair, proximal, distal, ratio to standing height, mass, centre of mass from the near end. Parameters of the demonstration.
SEGMENTS = [
    ("left_upper_arm", "upper_arm", 0, 1, 0.19, 0.027, 0.576),
    ("right_upper_arm", "upper_arm", 3, 4, 0.19, 0.027, 0.576),
    ("left_forearm", "forearm", 1, 2, 0.15, 0.022, 0.457),
    ("right_forearm", "forearm", 4, 5, 0.15, 0.022, 0.457),
    ("left_thigh", "thigh", 6, 7, 0.24, 0.145, 0.385),
    ("right_thigh", "thigh", 9, 10, 0.24, 0.145, 0.385),
    ("left_shank", "shank", 7, 8, 0.24, 0.046, 0.444),
    ("right_shank", "shank", 10, 11, 0.24, 0.046, 0.444),
    ("left_foot", "foot", 8, 13, 0.1, 0.013, 0.42),
    ("right_foot", "foot", 11, 14, 0.1, 0.013, 0.42),
    ("head", "head", 12, 15, 0.1, 0.068, 0.594),
    ("spine", "spine", 15, 16, 0.3, 0.426, 0.432),
]


def _look_at(x: float, y: float, z: float) -> tuple[float, ...]:
    """World to camera at (x, y, z) that looks at (0, 0, 1500) with the image's y pointing down."""
    fx, fy, fz = -x, -y, 1500.0 - z
    n = math.sqrt(fx * fx + fy * fy + fz * fz)
    f = (fx / n, fy / n, fz / n)
    m = math.hypot(f[0], f[1])
    r = (f[1] / m, -f[0] / m, 0.0)
    d = (f[1] * r[2] - f[2] * r[1], f[2] * r[0] - f[0] * r[2], f[0] * r[1] - f[1] * r[0])
    rows = (r, d, f)
    return tuple(c for row in rows for c in row) + tuple(-(row[0] * x + row[1] * y + row[2] * z) for row in rows)


CAMERA_COLUMNS = ["camera_id", *(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"]
CAMERAS = [
    (f"cam{n}", *_look_at(*at), 500.0 + 10 * n, 505.0 + 10 * n, 320.0, 240.0, 0.02, -0.003, 0.001, -0.0005)
    for n, at in enumerate([(3000.0, 0.0, 1800.0), (0.0, 3000.0, 1700.0), (-3000.0, 0.0, 1600.0), (0.0, -3000.0, 1500.0)])
]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, label, keypoint (k as text), x, y, z."""
    at = lambda k, n: F.get("embedding", k * 3 + n).cast("double") * 1000
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(KEYPOINTS - 1)), lambda k: F.struct(
        k.cast("string").alias("keypoint"), at(k, 0).alias("x"), at(k, 1).alias("y"), (at(k, 2) + 1500).alias("z"))))
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("frame"), "label", each.alias("p")).select("frame", "label", "p.*")


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "camera_id string, " + ", ".join(f"{c} double" for c in CAMERA_COLUMNS[1:]))


def segments(spark: SparkSession) -> DataFrame:
    rows = [(s, p, str(a), str(b), r, m, c) for s, p, a, b, r, m, c in SEGMENTS]
    return spark.createDataFrame(rows, "segment string, pair string, proximal string, distal string, ratio double, mass double, com double")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point through every camera; visibility from the numbers, so that some views are poor."""
    views = points(spark, sf_dir).crossJoin(F.broadcast(cameras(spark)))  # four constant rows
    number = F.substring("camera_id", 4, 1).cast("int")
    poor = F.pmod(F.col("frame") * 7 + F.col("keypoint").cast("int") * 3 + number * 5, F.lit(11))
    return views.withColumn("visibility", poor / 10)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (seconds), user, type, value; unique by (user, t)."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return df.select(t.alias("t"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value", "event_id")


def values_sql(rows: list[tuple], names: list[str]) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS v({', '.join(names)}))"


POINTS_SQL = (
    "SELECT vec_id AS frame, label, k::VARCHAR AS keypoint, embedding[3*k+1]::DOUBLE*1000 AS x, embedding[3*k+2]::DOUBLE*1000 AS y, "
    "embedding[3*k+3]::DOUBLE*1000+1500 AS z FROM embeddings, range(21) AS r(k)"
)
CAMERAS_SQL = values_sql(CAMERAS, CAMERA_COLUMNS)
SEGMENTS_SQL = values_sql([(s, p, str(a), str(b), r, m, c) for s, p, a, b, r, m, c in SEGMENTS], ["segment", "pair", "proximal", "distal", "ratio", "mass", "com"])
SEEN_SQL = (
    f"SELECT p.*, c.*, ((frame*7 + keypoint::INT*3 + camera_id[4:4]::INT*5) % 11)/10.0::DOUBLE AS visibility FROM ({POINTS_SQL}) p, {CAMERAS_SQL} c"
)
PROJECTED_SQL = f"""SELECT *, fx*(a*rad + 2*p1*a*b + p2*(r2+2*a*a)) + cx AS u, fy*(b*rad + p1*(r2+2*b*b) + 2*p2*a*b) + cy AS v FROM (
  SELECT *, 1 + k1*r2 + k2*r2*r2 AS rad FROM (SELECT *, a*a+b*b AS r2 FROM (
    SELECT *, (r00*x+r01*y+r02*z+t0)/(r20*x+r21*y+r22*z+t2) AS a, (r10*x+r11*y+r12*z+t1)/(r20*x+r21*y+r22*z+t2) AS b FROM ({SEEN_SQL}))))"""
EVENTS_SQL = "SELECT epoch_us(ts)/1e6::DOUBLE AS t, ts, user_id AS \"user\", event_type AS type, value, event_id FROM events"
