"""Camera rigs: rigid fits, spanning trees of shared views, ground planes, comparison of calibrations.

What grows with recordings is summed by Spark; what has the size of a rig (tens of cameras) is solved on
the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import rotation_angle
from . import windows

AXES = ("x", "y", "z")


def kabsch_sums(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sums a rigid fit needs. pairs: x, y, z and the target x2, y2, z2."""
    products = [F.sum(F.col(a) * F.col(f"{b}2")).alias(f"{a}{b}") for a in AXES for b in AXES]
    singles = [F.sum(c).alias(f"s_{c}") for c in (*AXES, *(f"{a}2" for a in AXES))]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *singles, *products)


def kabsch(row) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of least squares from a row of kabsch_sums; at least 3 points off a line."""
    n = row["n"]
    a, b = np.array([row[f"s_{c}"] for c in AXES]) / n, np.array([row[f"s_{c}2"] for c in AXES]) / n
    h = np.array([[row[f"{i}{j}"] for j in AXES] for i in AXES]) - n * np.outer(a, b)
    u, s, vt = np.linalg.svd(h)
    if n < 3 or s[1] <= 1e-9 * max(s[0], 1e-12):
        raise ValueError("a rigid fit needs at least 3 points that are not on a line")
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return turn, b - turn @ a


def spanning_tree(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Heaviest tree over cameras, by weight and then by name; raises if they do not hang together."""
    root = {n: n for e in edges for n in e[:2]}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    tree = []
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.append((a, b, w))
    if len({find(n) for n in root}) > 1:
        raise ValueError("some cameras share no view with the others")
    return tree


def tree_pairs(tree: list[tuple[str, str, float]], start: str) -> list[tuple[str, str]]:
    """(parent, child) outwards from a camera."""
    near: dict[str, list[str]] = {}
    for a, b, _ in tree:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    found, seen, queue = [], {start}, [start]
    while queue:
        at = queue.pop(0)
        for other in sorted(near.get(at, [])):
            if other not in seen:
                seen.add(other)
                found.append((at, other))
                queue.append(other)
    return found


def rodrigues(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = np.linalg.norm(v)
    if angle == 0:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def rotation_vector(r: np.ndarray) -> np.ndarray:
    q = quaternion(r)
    size = np.linalg.norm(q[1:])
    return 2 * np.arctan2(size, q[0]) * q[1:] / size if size > 1e-12 else np.zeros(3)


def quaternion(r: np.ndarray) -> np.ndarray:
    """w, x, y, z with w >= 0: the eigenvector of the largest eigenvalue of Bar-Itzhack's matrix."""
    k = np.array(
        [
            [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
            [0, r[0, 0] - r[1, 1] - r[2, 2], r[1, 0] + r[0, 1], r[2, 0] + r[0, 2]],
            [0, 0, r[1, 1] - r[0, 0] - r[2, 2], r[2, 1] + r[1, 2]],
            [0, 0, 0, r[2, 2] - r[0, 0] - r[1, 1]],
        ]
    )
    q = np.linalg.eigh(k + np.triu(k, 1).T)[1][:, -1]
    return q if q[0] >= 0 else -q


def chain(pairs: list[tuple[str, str]], relative: dict, start: str) -> dict[str, np.ndarray]:
    """World-to-camera 4x4 matrices from the start camera outwards; relative[(a, b)] takes camera a's coordinates to b's."""
    found = {start: np.eye(4)}
    for a, b in pairs:
        step = relative[a, b] if (a, b) in relative else np.linalg.inv(relative[b, a])
        found[b] = step @ found[a]
    return found


def pin_to(extrinsics: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    """Moves the world so that a camera is its origin."""
    back = np.linalg.inv(extrinsics[name])
    return {k: v @ back for k, v in extrinsics.items()}


def ground_axes(board_turn: np.ndarray, origin: np.ndarray, cameras: np.ndarray) -> np.ndarray:
    """Board axes with z turned to the side of the cameras and y = z x x."""
    x, z = board_turn[:, 0], board_turn[:, 2]
    if (cameras.mean(axis=0) - origin) @ z < 0:
        z = -z
    return np.column_stack((x, np.cross(z, x), z))


def to_ground(extrinsic: np.ndarray, axes: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """A camera's matrix for a world whose axes and origin are the ground's."""
    moved = extrinsic.copy()
    moved[:3, 3] = extrinsic[:3, :3] @ origin + extrinsic[:3, 3]
    moved[:3, :3] = extrinsic[:3, :3] @ axes
    return moved


def average_transform(turns: np.ndarray, shifts: np.ndarray, shares: tuple[float, ...] = (0.5, 0.3, 0.15, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """Robust mean of rigid motions: start at the medians, then average the nearest share (3 at least), ever fewer."""
    v = np.column_stack(([rotation_vector(r) for r in turns], shifts))
    scale = np.where((s := np.median(np.abs(v - np.median(v, axis=0)), axis=0)) > 0, s, 1)
    at = np.median(v, axis=0)
    for share in shares:
        near = np.argsort((((v - at) / scale) ** 2).sum(axis=1), kind="stable")[: max(3, int(len(v) * share))]
        at = v[near].mean(axis=0)
    return rodrigues(at[:3]), at[3:]


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per camera of both calibrations: focal_delta, center_delta, position_delta, angle. Columns as of a camera, and px, py, pz."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    joined = a.join(b.select("camera_id", *[F.col(c).alias(f"{c}_b") for c in ("fx", "fy", "cx", "cy", "px", "py", "pz", *names)]), "camera_id")
    gap = lambda *cs: F.sqrt(sum(((F.col(c) - F.col(f"{c}_b")) * (F.col(c) - F.col(f"{c}_b")) for c in cs), F.lit(0.0)))
    return joined.select(
        "camera_id", gap("fx", "fy").alias("focal_delta"), gap("cx", "cy").alias("center_delta"),
        gap("px", "py", "pz").alias("position_delta"),
        rotation_angle([F.col(n) for n in names], [F.col(f"{n}_b") for n in names]).alias("angle"),
    )


def summary(deltas: DataFrame) -> DataFrame:
    """One row: n_cameras, and mean and largest of each difference of `compare`."""
    names = {"focal": "focal_delta", "center": "center_delta", "position": "position_delta", "angle": "angle"}
    told = [f(c).alias(f"{k}_{n}") for n, c in names.items() for k, f in (("mean", F.avg), ("max", F.max))]
    return deltas.agg(F.count("*").alias("n_cameras"), *told)


def compare_strictly(a: DataFrame, b: DataFrame) -> DataFrame:
    """As `compare`; the query fails if one side has a camera that the other lacks."""
    from .align import same_ids

    odd = same_ids(a, b, "camera_id").agg(F.array_sort(F.collect_list("camera_id")).alias("_odd"))
    checked = compare(a, b).join(F.broadcast(odd))  # one row
    fail = F.raise_error(F.concat(F.lit("cameras of one calibration only: "), F.array_join("_odd", ", ")))
    return checked.withColumn("angle", F.when(F.size("_odd") == 0, F.col("angle")).otherwise(fail)).drop("_odd")


def ground_plane(corners: DataFrame, board: DataFrame, cameras: np.ndarray, by: str, limit: float, least: int, least_seen: int = 3) -> DataFrame:
    """by, n_frames, origin ox, oy, oz and axes g00 to g22 (columns) of the floor that a lying board shows, per recording.

    The longest run of frames in which the board rests (median motion under `limit`, `least` frames at least) gives a median
    place of each corner, and these a rigid fit to the board (corner_id, bx, by, by its own plane). Axes as of ground_axes;
    cameras: positions, (C, 3). Recordings without such a run, or with corners on a line, are absent.
    """
    runs = windows.stable_runs(windows.board_motion(corners, least_seen, (by,)), by, "frame", limit, least)
    inside = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + F.col("n_frames"))
    still = corners.join(runs.select(by, "start", "n_frames"), by).where(inside)
    places = windows.corner_medians(still, least_seen, (by,)).select(by, "corner_id", *[F.col(c).alias(f"{c}2") for c in AXES])
    flat = F.broadcast(board.select("corner_id", F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(0.0).alias("z")))
    sums = kabsch_sums(places.join(flat, "corner_id"), (by,)).join(runs.select(by, "n_frames"), by)
    names = [f"g{i}{j}" for i in range(3) for j in range(3)]
    kind = corners.schema[by].dataType.simpleString()

    def fit(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    turn, origin = kabsch(row)
                except ValueError:
                    continue
                out.append((row[by], row["n_frames"], *origin, *ground_axes(turn, origin, cameras).ravel()))
            yield pd.DataFrame(out, columns=[by, "n_frames", "ox", "oy", "oz", *names])

    return sums.mapInPandas(fit, f"`{by}` {kind}, n_frames long, " + ", ".join(f"{n} double" for n in ("ox", "oy", "oz", *names)))
