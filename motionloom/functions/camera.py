"""Pinhole cameras as column expressions: projection, undistortion, reprojection errors, rotations.

A camera is twelve extrinsic columns r00..r22, t0..t2 (world to camera) and eight intrinsic ones fx, fy,
cx, cy, k1, k2, p1, p2. Everything here is arithmetic on columns, so that it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTRINSICS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")
EXTRINSICS = tuple(f"r{i}{j}" for i in range(3) for j in range(3)) + ("t0", "t1", "t2")


def in_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """World coordinates seen from the row's camera."""
    c = F.col
    return tuple(c(f"r{i}0") * x + c(f"r{i}1") * y + c(f"r{i}2") * z + c(f"t{i}") for i in range(3))


def normalized(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds a, b: coordinates in the plane at distance 1; null behind the camera or in its plane."""
    cx, cy, cz = in_camera(F.col(x), F.col(y), F.col(z))
    df = df.withColumns({"_cx": cx, "_cy": cy, "_cz": cz})
    front = F.col("_cz") > 1e-6
    return df.withColumns(
        {"a": F.when(front, F.col("_cx") / F.col("_cz")), "b": F.when(front, F.col("_cy") / F.col("_cz"))}
    ).drop("_cx", "_cy", "_cz")


def distorted(df: DataFrame) -> DataFrame:
    """Adds u, v: pixels of the normalized a, b."""
    a, b, k1, k2, p1, p2 = (F.col(c) for c in ("a", "b", "k1", "k2", "p1", "p2"))
    df = df.withColumn("_r2", a * a + b * b)
    r2 = F.col("_r2")
    radial = 1 + k1 * r2 + k2 * r2 * r2
    xd = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
    yd = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    return df.withColumns({"u": F.col("fx") * xd + F.col("cx"), "v": F.col("fy") * yd + F.col("cy")}).drop("_r2")


def project(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds a, b, u, v of a world point."""
    return distorted(normalized(df, x, y, z))


def undistort(df: DataFrame, u: str = "u", v: str = "v", iterations: int = 5) -> DataFrame:
    """Adds un, vn: normalized coordinates of pixels, by fixed-point iteration."""
    k1, k2, p1, p2 = (F.col(c) for c in ("k1", "k2", "p1", "p2"))
    first = {"_u0": (F.col(u) - F.col("cx")) / F.col("fx"), "_v0": (F.col(v) - F.col("cy")) / F.col("fy")}
    df = df.withColumns(first).withColumns({"un": F.col("_u0"), "vn": F.col("_v0")})
    un, vn = F.col("un"), F.col("vn")
    for _ in range(iterations):
        df = df.withColumn("_r2", un * un + vn * vn)
        r2 = F.col("_r2")
        radial = 1 + k1 * r2 + k2 * r2 * r2
        df = df.withColumns(
            {
                "un": (F.col("_u0") - (2 * p1 * un * vn + p2 * (r2 + 2 * un * un))) / radial,
                "vn": (F.col("_v0") - (p1 * (r2 + 2 * vn * vn) + 2 * p2 * un * vn)) / radial,
            }
        )
    return df.drop("_u0", "_v0", "_r2")


def pixel_error(u_seen: Column, v_seen: Column, u: Column, v: Column) -> Column:
    """Distance in pixels; null if any coordinate is."""
    return F.sqrt((u_seen - u) * (u_seen - u) + (v_seen - v) * (v_seen - v))


def rotation_angle(r: list[Column], q: list[Column]) -> Column:
    """Degrees between two rotations given as nine columns each, row by row."""
    trace = sum((a * b for a, b in zip(r[1:], q[1:], strict=True)), r[0] * q[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def rotate(x: Column, y: Column, z: Column, rx: Column, ry: Column, rz: Column) -> tuple[Column, Column, Column]:
    """Points turned by per-row rotation vectors; a zero vector leaves them."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    safe = F.when(angle == 0, F.lit(1.0)).otherwise(angle)
    kx, ky, kz = rx / safe, ry / safe, rz / safe
    dot, c, s = kx * x + ky * y + kz * z, F.cos(angle), F.sin(angle)
    return (
        x * c + (ky * z - kz * y) * s + kx * dot * (1 - c),
        y * c + (kz * x - kx * z) * s + ky * dot * (1 - c),
        z * c + (kx * y - ky * x) * s + kz * dot * (1 - c),
    )


def flatten_z(df: DataFrame) -> DataFrame:
    """Projects points on the ground plane."""
    return df.withColumn("z", F.lit(0.0))


def quarter_turn_x(df: DataFrame) -> DataFrame:
    """(x, y, z) to (x, z, -y)."""
    return df.withColumns({"y": F.col("z"), "z": -F.col("y")})


def planar_frame(u: Column, v: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """One camera, one frame: pixels to a standing plane around the image's middle."""
    return u - width / 2, F.lit(0.0), height - v


def planar_recording(df: DataFrame, by: str = "recording_id") -> DataFrame:
    """One camera, a whole recording: (u - middle of its extent, 0, largest v - v), with extents over the recording."""
    extent = df.groupBy(by).agg(F.min("u").alias("_lo"), F.max("u").alias("_hi"), F.max("v").alias("_top"))
    return (
        df.join(extent, by)
        .withColumns({"x": F.col("u") - (F.col("_lo") + F.col("_hi")) / 2, "y": F.lit(0.0), "z": F.col("_top") - F.col("v")})
        .drop("_lo", "_hi", "_top")
    )


def signed_error(u: Column, v: Column, projected_u: Column, projected_v: Column) -> tuple[Column, Column]:
    """Observation less projection, by axis."""
    return u - projected_u, v - projected_v
