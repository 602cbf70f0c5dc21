"""3D points from several cameras: least squares over Arrow batches, with rejection of outlying cameras.

Observations are gathered per point, an array of at most as many entries as there are cameras, and go to
numpy in Arrow batches. Within a batch points are grouped by the set of cameras that see them, so that
one batched SVD serves all points of a set.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import EXTRINSICS


@dataclass(frozen=True)
class Rejection:
    """target: error in normalized units under which a solution is good; up to max_drop cameras are left out."""

    target: float = 0.01
    min_cameras: int = 2
    max_drop: int = 2
    decay: float = 5.0


def solve(points: np.ndarray, cameras: np.ndarray) -> np.ndarray:
    """(P, C, 2) normalized observations and (C, 3, 4) matrices to (P, 3): the smallest singular vector of each system."""
    u, v = points[..., 0, None], points[..., 1, None]
    rows = np.concatenate((u * cameras[:, 2] - cameras[:, 0], v * cameras[:, 2] - cameras[:, 1]), axis=1)
    last = np.linalg.svd(rows)[2][:, -1]
    return last[:, :3] / last[:, 3:]


def errors(solved: np.ndarray, points: np.ndarray, cameras: np.ndarray) -> np.ndarray:
    """(P, C) distances in normalized units."""
    seen = np.einsum("cij,pj->pci", cameras[:, :, :3], solved) + cameras[:, :, 3]
    return np.linalg.norm(seen[..., :2] / seen[..., 2:] - points, axis=2)


def subsets(cameras: int, config: Rejection) -> np.ndarray:
    """(S, C) flags of the cameras that each candidate uses: first all of them, then with ever more left out."""
    fewest = max(cameras - config.max_drop, config.min_cameras)
    kept = [k for size in range(cameras, min(fewest, cameras) - 1, -1) for k in combinations(range(cameras), size)]
    flags = np.zeros((len(kept), cameras), bool)
    for n, k in enumerate(kept):
        flags[n, list(k)] = True
    return flags


def robust(points: np.ndarray, cameras: np.ndarray, config: Rejection, all_seen: bool) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and camera weights, of points (P, C, 2).

    The rule: a point whose mean error with all cameras is under the target keeps that solution, and every camera counts
    1. For another, each candidate of `subsets` is solved by itself. If one has a smaller error than all cameras
    together, the point becomes the mean of the candidates with weights in proportion to exp(-decay * error / target),
    and a camera counts as much as the candidates that use it; else it stays as it was. A point that not all cameras
    see leaves out candidates smaller than the largest ones that meet the target.
    """
    plain = solve(points, cameras)
    first = errors(plain, points, cameras).mean(axis=1)
    weights = np.ones(points.shape[:2])
    poor = np.flatnonzero(~(first < config.target))
    flags = subsets(points.shape[1], config)
    if not len(poor) or len(flags) < 2:
        return plain, weights
    part = points[poor]
    at = np.stack([solve(part[:, f], cameras[f]) for f in flags])  # (S, P, 3)
    error = np.stack([errors(x, part[:, f], cameras[f]).mean(axis=1) for x, f in zip(at, flags, strict=True)])
    error[~np.isfinite(error)] = np.inf
    if not all_seen:
        size = flags.sum(axis=1)[:, None]
        enough = np.where(error < config.target, size, 0).max(axis=0)
        error = np.where(size < enough, np.inf, error)
    share = np.exp(-config.decay / config.target * (error - error.min(axis=0)))  # the best has 1: none can vanish
    share /= share.sum(axis=0)
    mixed = np.einsum("sp,spi->pi", share, np.where(np.isfinite(error)[..., None], at, 0.0))
    better = error[1:].min(axis=0) < error[0]
    plain[poor[better]], weights[poor[better]] = mixed[better], (share.T @ flags)[better]
    return plain, weights


def triangulate(obs: DataFrame, cameras: DataFrame, config: Rejection | None = None, by: tuple[str, ...] = ("frame", "keypoint")) -> DataFrame:
    """by, x, y, z, n_cameras, weights (map camera to weight). obs: by, camera_id, un, vn (normalized); null ones are unseen.

    cameras (camera_id and EXTRINSICS) is a calibration of a few cameras and goes to all tasks. Points seen by one camera or
    none are absent. Without a config all cameras count equally.
    """
    rig = sorted(cameras.select("camera_id", *EXTRINSICS).collect())
    names = [r["camera_id"] for r in rig]
    matrices = np.array([[[*(r[f"r{i}{j}"] for j in range(3)), r[f"t{i}"]] for i in range(3)] for r in rig]).reshape(-1, 3, 4)
    index = F.array_position(F.array(*map(F.lit, names)), F.col("camera_id")) - 1
    seen = obs.where("un is not null and vn is not null").select(*by, index.cast("int").alias("c"), "un", "vn").where("c >= 0")
    gathered = seen.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", "un", "vn"))).alias("o"))
    once = F.filter("o", lambda o, n: (n == 0) | (F.get("o", n - 1)["c"] != o["c"]))  # of a camera listed twice, the first
    gathered = gathered.withColumn("o", once).where(F.size("o") >= 2)
    keys = ", ".join(f"`{k}` {obs.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{keys}, x double, y double, z double, n_cameras int, weights map<string,double>"
    weights_type = pa.map_(pa.string(), pa.float64())

    def each(batches):
        for batch in batches:
            column = batch.column(len(by))
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            c, u, v = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = batch.num_rows
            counts = np.diff(offsets)
            base = offsets[:-1] - offsets[0]
            xyz, told = np.full((n, 3), np.nan), [None] * n
            for size in np.unique(counts):
                own = np.flatnonzero(counts == size)
                take = base[own][:, None] + np.arange(size)
                sets, which = np.unique(c[take], axis=0, return_inverse=True)
                for k, used in enumerate(sets):
                    here = which.ravel() == k
                    rows, points = own[here], np.stack((u[take[here]], v[take[here]]), axis=2)
                    if config is None:
                        at, w = solve(points, matrices[used]), np.full((len(rows), len(used)), 1 / len(used))
                    else:
                        at, w = robust(points, matrices[used], config, len(used) == len(names))
                    xyz[rows] = at
                    for r, weights in zip(rows, w.tolist(), strict=True):
                        told[r] = list(zip((names[i] for i in used), weights, strict=True))
            arrays = [*batch.columns[: len(by)], *(pa.array(xyz[:, i]) for i in range(3)), pa.array(counts.astype(np.int32)), pa.array(told, weights_type)]
            yield pa.RecordBatch.from_arrays(arrays, [*by, "x", "y", "z", "n_cameras", "weights"])

    return gathered.mapInArrow(each, schema)


def rig_subset(cameras: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted cameras of a calibration, numbered `ord` in that order; raises on a name that it lacks or that comes twice."""
    known = {r["camera_id"] for r in cameras.select("camera_id").collect()}  # a rig
    if unknown := [w for w in wanted if w not in known]:
        raise ValueError(f"cameras {unknown} are not calibrated")
    if len(set(wanted)) < len(wanted):
        raise ValueError(f"a camera is wanted twice: {wanted}")
    order = cameras.sparkSession.createDataFrame(list(enumerate(wanted)), "ord int, camera_id string")
    return cameras.join(F.broadcast(order), "camera_id")


def pixel_matrices(cameras: DataFrame) -> DataFrame:
    """camera_id and the nine-by-four products K [R t] as extrinsics of their own (r00 to r22, t0 to t2), for points in pixels."""
    rows = [(F.col("fx"), "0", F.col("cx")), (F.col("fy"), "1", F.col("cy"))]
    made = {f"{k}{i}{s}": f * F.col(f"{k}{i}{s}") + c * F.col(f"{k}2{s}") for f, i, c in rows for k, s in (("r", "0"), ("r", "1"), ("r", "2"))}
    made |= {f"t{i}": f * F.col(f"t{i}") + c * F.col("t2") for f, i, c in rows}
    return cameras.select("camera_id", *[made.get(n, F.col(n)).alias(n) for n in EXTRINSICS])


def triangulate_pixels(obs: DataFrame, cameras: DataFrame, by: tuple[str, ...] = ("frame", "keypoint")) -> DataFrame:
    """by, x, y, z from raw pixels u, v without undistortion, all cameras alike."""
    pixels = obs.select(*by, "camera_id", F.col("u").alias("un"), F.col("v").alias("vn"))
    return triangulate(pixels, pixel_matrices(cameras), None, by).select(*by, "x", "y", "z")
