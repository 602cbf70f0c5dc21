"""A flat board in views: its homography and pose in every view, and a camera's intrinsics from many views.

Views are many; each has a board's few corners. Arrow batches of views are solved together: sums of corners per view make
small matrices, which numpy factors for all views at once. What is summed over views is summed by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CORNERS = 6
H = [f"h{i}{j}" for i in range(3) for j in range(3)]
POSE = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]


def _by_view(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of views: view number of each corner, board places, pixels, where each view starts."""
    sizes = np.array([len(c) for c in batch["corners"]])
    flat = np.array([[c["bx"], c["by"], c["u"], c["v"]] for corners in batch["corners"] for c in corners], float).reshape(-1, 4)
    return np.repeat(np.arange(len(sizes)), sizes), flat[:, :2], flat[:, 2:], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _normalised(xy: np.ndarray, view: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved and scaled per view to mean 0 and mean distance sqrt 2, and the (V, 3, 3) matrices that do it."""
    sizes = np.bincount(view, minlength=len(starts))
    mean = np.add.reduceat(xy, starts) / sizes[:, None]
    off = xy - mean[view]
    spread = np.add.reduceat(np.hypot(*off.T), starts) / sizes
    scale = np.sqrt(2) / np.where(spread > 0, spread, 1)
    t = np.zeros((len(starts), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = scale
    t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = -scale * mean[:, 0], -scale * mean[:, 1], 1
    return off * scale[view][:, None], t


def homographies(view: np.ndarray, board: np.ndarray, image: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(V, 3, 3): board plane to image, of all views at once; the last entry of each is positive."""
    a, to_a = _normalised(board, view, starts)
    b, to_b = _normalised(image, view, starts)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack((a, one))
    rows = np.stack((np.hstack((p, zero, -b[:, :1] * p)), np.hstack((zero, p, -b[:, 1:] * p))), axis=1)
    sums = np.add.reduceat(np.einsum("nki,nkj->nij", rows, rows), starts)
    h = np.linalg.eigh(sums)[1][:, :, 0].reshape(-1, 3, 3)
    h = np.linalg.inv(to_b) @ h @ to_a
    return h / h[:, 2:, 2:]


def turned(vectors: np.ndarray) -> np.ndarray:
    """(V, 3, 3) rotations by rotation vectors (V, 3)."""
    angle = np.linalg.norm(vectors, axis=1)[:, None, None]
    safe = np.where(angle > 0, angle, 1)
    k = np.zeros((len(vectors), 3, 3))
    x, y, z = vectors.T
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -z, y, -x
    k -= k.transpose(0, 2, 1)
    return np.eye(3) + np.sinc(angle / np.pi) * k + (1 - np.cos(angle)) / (safe * safe) * (k @ k)


def undistorted(image: np.ndarray, camera: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Normalised coordinates of pixels (N, 2); camera: fx, fy, cx, cy, k1, k2, p1, p2 of each (N, 8)."""
    fx, fy, cx, cy, k1, k2, p1, p2 = camera.T
    seen = np.column_stack(((image[:, 0] - cx) / fx, (image[:, 1] - cy) / fy))
    at = seen.copy()
    for _ in range(rounds):
        a, b = at.T
        r2 = a * a + b * b
        radial = 1 + k1 * r2 + k2 * r2 * r2
        tangent = np.column_stack((2 * p1 * a * b + p2 * (r2 + 2 * a * a), p1 * (r2 + 2 * b * b) + 2 * p2 * a * b))
        at = (seen - tangent) / radial[:, None]
    return at


def poses(view: np.ndarray, board: np.ndarray, image: np.ndarray, camera: np.ndarray, starts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations (V, 3, 3), shifts (V, 3) and root mean square pixel errors of all views; camera: (V, 8) as of `undistorted`.

    Starts at the homography of undistorted corners and goes down the pixel errors by Gauss-Newton steps of all views."""
    own = camera[view]
    h = homographies(view, board, undistorted(image, own), starts)
    h /= np.sqrt(np.linalg.norm(h[:, :, 0], axis=1) * np.linalg.norm(h[:, :, 1], axis=1))[:, None, None]
    h *= np.where(h[:, 2, 2] < 0, -1, 1)[:, None, None]  # the board is before the camera
    u, _, w = np.linalg.svd(np.stack((h[:, :, 0], h[:, :, 1], np.cross(h[:, :, 0], h[:, :, 1])), axis=2))
    turn, shift = u @ w, h[:, :, 2].copy()
    places = np.column_stack((board, np.zeros(len(board))))
    fx, fy, cx, cy, k1, k2, p1, p2 = own.T

    def seen(turn, shift):
        around = np.einsum("nij,nj->ni", turn[view], places)
        p = around + shift[view]
        a, b = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
        r2 = a * a + b * b
        radial = 1 + k1 * r2 + k2 * r2 * r2
        x, y = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a), b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
        return around, p, a, b, r2, radial, np.column_stack((fx * x + cx, fy * y + cy)) - image

    for _ in range(rounds):
        around, p, a, b, r2, radial, error = seen(turn, shift)
        grow = 2 * k1 + 4 * k2 * r2
        dxda, dxdb = radial + a * a * grow + 2 * p1 * b + 6 * p2 * a, a * b * grow + 2 * p1 * a + 2 * p2 * b
        dyda, dydb = a * b * grow + 2 * p1 * a + 2 * p2 * b, radial + b * b * grow + 6 * p1 * b + 2 * p2 * a
        z = 1 / p[:, 2]
        to_p = np.stack((
            np.column_stack((fx * dxda * z, fx * dxdb * z, -fx * (dxda * a + dxdb * b) * z)),
            np.column_stack((fy * dyda * z, fy * dydb * z, -fy * (dyda * a + dydb * b) * z)),
        ), axis=1)
        q = np.zeros((len(p), 3, 3))  # d p / d turn
        q[:, 0, 1], q[:, 0, 2], q[:, 1, 2] = around[:, 2], -around[:, 1], around[:, 0]
        q -= q.transpose(0, 2, 1)
        j = np.concatenate((to_p @ q, to_p), axis=2)
        normal = np.add.reduceat(np.einsum("nki,nkj->nij", j, j), starts)
        slope = np.add.reduceat(np.einsum("nki,nk->ni", j, error), starts)
        normal += 1e-12 * np.trace(normal, axis1=1, axis2=2)[:, None, None] * np.eye(6)
        step = -np.linalg.solve(normal, slope[:, :, None])[:, :, 0]
        turn, shift = turned(step[:, :3]) @ turn, shift + step[:, 3:]
    error = seen(turn, shift)[-1]
    return turn, shift, np.sqrt(np.add.reduceat((error**2).sum(axis=1), starts) / np.bincount(view, minlength=len(starts)))


def views_of(corners: DataFrame, board: DataFrame, by: list[str], least: int = LEAST_CORNERS) -> DataFrame:
    """by, corners: one row a view with `least` corners or more. corners: by, corner_id, u, v (null: not seen); board: corner_id,
    bx, by (a fixed table, broadcast)."""
    met = corners.where("u is not null and v is not null").join(F.broadcast(board.select("corner_id", "bx", F.col("by").alias("_by"))), "corner_id")
    entry = F.struct("corner_id", F.col("bx").cast("double").alias("bx"), F.col("_by").cast("double").alias("by"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return met.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("corners")).where(F.size("corners") >= least)


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)


def board_homographies(views: DataFrame, by: list[str]) -> DataFrame:
    """by, h00 to h22 (h22 is 1): the board's plane to pixels, of `views_of`. Views whose corners lie on a line give no number (null)."""

    def solve(batches):
        for batch in batches:
            if len(batch):
                h = homographies(*_by_view(batch)).reshape(-1, 9)
                yield batch[by].join(pd.DataFrame(np.where(np.isfinite(h), h, np.nan), columns=H, index=batch.index))

    return views.mapInPandas(solve, f"{_keys(views, by)}, " + ", ".join(f"{c} double" for c in H))


def board_poses(views: DataFrame, cameras: DataFrame, by: list[str], rounds: int = 12) -> DataFrame:
    """by, r00 to r22, t0 to t2 (board to camera), rms (pixels): the board's pose in every view. by holds camera_id; cameras:
    camera_id, fx, fy, cx, cy, k1, k2, p1, p2 (a rig's few rows, broadcast)."""
    names = ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"]
    met = views.join(F.broadcast(cameras.select("camera_id", *names)), "camera_id")

    def solve(batches):
        for batch in batches:
            if len(batch):
                view, board, image, starts = _by_view(batch)
                turn, shift, rms = poses(view, board, image, batch[names].to_numpy(float), starts, rounds)
                told = np.column_stack((turn.reshape(-1, 9), shift, rms))
                yield batch[by].join(pd.DataFrame(told, columns=[*POSE, "rms"], index=batch.index))

    return met.mapInPandas(solve, f"{_keys(views, by)}, " + ", ".join(f"{c} double" for c in [*POSE, "rms"]))


def intrinsic_sums(found: DataFrame, by: list[str]) -> DataFrame:
    """by, n_views and s00 to s55 (upper half): sums over views of the products of Zhang's two constraints on the image of the
    absolute conic, as column expressions of h00 to h22. Each homography counts at unit length of its first two columns."""
    h = lambda i, j: F.col(f"h{j - 1}{i - 1}")  # noqa: E731  (column i, row j)

    def v(i, j):
        return [
            h(i, 1) * h(j, 1), h(i, 1) * h(j, 2) + h(i, 2) * h(j, 1), h(i, 2) * h(j, 2),
            h(i, 3) * h(j, 1) + h(i, 1) * h(j, 3), h(i, 3) * h(j, 2) + h(i, 2) * h(j, 3), h(i, 3) * h(j, 3),
        ]

    size = h(1, 1) * h(1, 1) + h(1, 2) * h(1, 2) + h(2, 1) * h(2, 1) + h(2, 2) * h(2, 2)
    first, second = v(1, 2), [a - b for a, b in zip(v(1, 1), v(2, 2), strict=True)]
    good = found.where("h00 is not null and not isnan(h00)")
    named = good.select(*by, size.alias("_s"), *[c.alias(f"_a{n}") for n, c in enumerate(first)], *[c.alias(f"_b{n}") for n, c in enumerate(second)])
    products = [
        F.sum((F.col(f"_a{i}") * F.col(f"_a{j}") + F.col(f"_b{i}") * F.col(f"_b{j}")) / (F.col("_s") * F.col("_s"))).alias(f"s{i}{j}")
        for i in range(6)
        for j in range(i, 6)
    ]
    return named.groupBy(*by).agg(F.count("*").alias("n_views"), *products)


def intrinsics(sums: DataFrame, by: list[str]) -> DataFrame:
    """by, n_views, fx, fy, cx, cy from `intrinsic_sums`, in closed form without skew; null where views do not tell (fewer than two,
    or all alike). Pixels are scaled inside, so that sums of squares of pixels do not drown the rest."""
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                m = np.zeros((6, 6))
                for i, j in pairs:
                    m[i, j] = m[j, i] = row[f"s{i}{j}"]
                keep = [0, 2, 3, 4, 5]  # no skew
                m = m[np.ix_(keep, keep)]
                scale = 1 / np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1))
                b11, b22, b13, b23, b33 = scale * np.linalg.eigh(m * scale * scale[:, None])[1][:, 0]
                cx, cy = -b13 / b11, -b23 / b22
                level = b33 - b13 * b13 / b11 - b23 * b23 / b22
                told = np.array([level / b11, level / b22])
                ok = row["n_views"] >= 2 and (told > 0).all() and np.isfinite([cx, cy]).all()
                out.append((*[row[k] for k in by], row["n_views"], *(np.sqrt(told) if ok else (None, None)), *((cx, cy) if ok else (None, None))))
            yield pd.DataFrame(out, columns=[*by, "n_views", "fx", "fy", "cx", "cy"])

    return sums.mapInPandas(solve, f"{_keys(sums, by)}, n_views long, fx double, fy double, cx double, cy double")
