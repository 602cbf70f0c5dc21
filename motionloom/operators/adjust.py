"""Bundle adjustment of a rig as sums over frames.

A frame's own unknowns (its corners in space and its board's pose) are eliminated inside the frame; what is left of it are
normal equations of the cameras, which Spark sums up over all frames. Only that rig-sized system is solved on the driver.
A frame's unknowns follow from the cameras (they are found again in every pass), so that nothing but the cameras is
carried from pass to pass, and a lost task is done again from its frames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boards import turned
from .lineage import cut
from .stats import held_percentiles, pair_percentiles

#: Unknowns of a camera: turn and shift (3 + 3), focal length, first radial distortion.
UNKNOWNS = 8
#: Frames whose views stand in arrays at once.
FRAMES_AT_ONCE = 500


@dataclass(frozen=True)
class Rig:
    """Cameras by name: world-to-camera turns (C, 3, 3) and shifts (C, 3), focal lengths, distortions, centres (C, 2)."""

    names: tuple[str, ...]
    turn: np.ndarray
    shift: np.ndarray
    focal: np.ndarray
    k1: np.ndarray
    centre: np.ndarray

    def moved(self, step: np.ndarray) -> Rig:
        step = step.reshape(len(self.names), UNKNOWNS)
        return replace(self, turn=turned(step[:, :3]) @ self.turn, shift=self.shift + step[:, 3:6], focal=self.focal + step[:, 6], k1=self.k1 + step[:, 7])

    def pixels(self, cam: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Pixels of points (N, 3) in cameras `cam` (N); null behind a camera."""
        return _project(self, cam, points)[0]


def _project(rig: Rig, cam: np.ndarray, points: np.ndarray):
    around = np.einsum("nij,nj->ni", rig.turn[cam], points)
    p = around + rig.shift[cam]
    z = np.where(p[:, 2] > 1e-6, p[:, 2], np.nan)
    a, b = p[:, 0] / z, p[:, 1] / z
    r2 = a * a + b * b
    radial = 1 + rig.k1[cam] * r2
    uv = np.column_stack((a, b)) * (rig.focal[cam] * radial)[:, None] + rig.centre[cam]
    return uv, around, z, a, b, r2, radial


def _toward(rig: Rig, cam: int, points: np.ndarray):
    """Points (3, N) through one camera: turned points, depth (null behind it), normalised a and b, squared radius, radial factor."""
    around = rig.turn[cam] @ points
    x, y, z = around + rig.shift[cam][:, None]
    z = np.where(z > 1e-6, z, np.nan)
    a, b = x / z, y / z
    r2 = a * a + b * b
    return around, z, a, b, r2, 1 + rig.k1[cam] * r2


def _slopes(rig: Rig, cam: int, points: np.ndarray, u: np.ndarray, v: np.ndarray, own: bool):
    """Errors of one camera's views of points (3, N), and the pixels' derivatives (two lists of rows) by the point; those by the
    camera's unknowns too if `own`."""
    around, z, a, b, r2, radial = _toward(rig, cam, points)
    f, grow = rig.focal[cam], 2 * rig.k1[cam] * rig.focal[cam]
    fr = f * radial
    error = a * fr + (rig.centre[cam, 0] - u), b * fr + (rig.centre[cam, 1] - v)
    daa, dab, dbb = (fr + grow * a * a) / z, grow * a * b / z, (fr + grow * b * b) / z
    to_p = np.stack((daa, dab, -daa * a - dab * b)), np.stack((dab, dbb, -dab * a - dbb * b))
    by_point = tuple(rig.turn[cam].T @ t for t in to_p)
    if not own:
        return error, by_point, None
    x, y, z = around
    turns = ((t[2] * y - t[1] * z, t[0] * z - t[2] * x, t[1] * x - t[0] * y) for t in to_p)
    return error, by_point, tuple(np.stack((*w, *t, c * radial, c * (f * r2))) for w, t, c in zip(turns, to_p, (a, b), strict=True))


def _factored(m: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Many small symmetric matrices, an array an entry of the lower triangle, as unit lower triangle and diagonal."""
    low, diagonal = [[None] * i for i in range(len(m))], []
    for i, row in enumerate(m):
        for j in range(i):
            low[i][j] = (row[j] - sum(low[i][k] * low[j][k] * diagonal[k] for k in range(j))) / diagonal[j]
        diagonal.append(row[i] - sum(low[i][k] * low[i][k] * diagonal[k] for k in range(i)))
    return low, diagonal


def _forward(low, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows with the lower triangle taken out."""
    done = []
    for i, row in enumerate(rows):
        done.append(row - sum(low[i][k] * done[k] for k in range(i)) if i else row)
    return done


def _backward(low, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows with the transposed lower triangle taken out."""
    done = list(rows)
    for i in reversed(range(len(rows) - 1)):
        done[i] = rows[i] - sum(low[k][i] * done[k] for k in range(i + 1, len(rows)))
    return done


def _last_directions(m: list[list[np.ndarray]]) -> np.ndarray:
    """(4, N) the eigenvector of the smallest eigenvalue of many 4 x 4 sums of squares. Inverse iteration, which begins at the
    least-squares point; where it does not stand still (two eigenvalues alike), all eigenvectors are computed."""
    low, diagonal = _factored(m)
    trace = m[0][0] + m[1][1] + m[2][2] + m[3][3]
    diagonal[3] = np.where(np.abs(diagonal[3]) < 1e-18 * trace, 1e-18 * trace, diagonal[3])
    zero = np.zeros_like(trace)
    last = np.stack(_backward(low, [zero, zero, zero, zero + 1]))
    last /= np.sqrt((last * last).sum(axis=0))
    for _ in range(8):
        rows = _forward(low, list(last))
        found = np.stack(_backward(low, [r / d for r, d in zip(rows, diagonal, strict=True)]))
        found /= np.sqrt((found * found).sum(axis=0)) * np.where((found * last).sum(axis=0) < 0, -1.0, 1.0)
        moved = np.abs(found - last).max(axis=0)
        last = found
        if (moved < 1e-14).all():
            break
    lost = np.flatnonzero(~(moved < 1e-14) & np.isfinite(trace))
    if len(lost):
        whole = np.empty((len(lost), 4, 4))
        for i in range(4):
            for j in range(i + 1):
                whole[:, i, j] = whole[:, j, i] = m[i][j][lost]
        last[:, lost] = np.linalg.eigh(whole)[1][:, :, 0].T
    return last


@dataclass(frozen=True)
class Frames:
    """Views of many frames side by side. by_camera: camera number, then of its views the place among all views, the point and
    the pixels. A point is a corner of a frame: its board's places are (3, N); a frame's points begin at `begins`, `owner` is a
    point's frame. `point` is the point of each view."""

    by_camera: tuple[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    point: np.ndarray
    board: np.ndarray
    owner: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, corner: np.ndarray, cam: np.ndarray, uv: np.ndarray, board: np.ndarray, frame: np.ndarray) -> Frames:
        """Views in order of their frames and corners; `frame` is the frame of each, frames of no view do not count."""
        first = np.ones(len(corner), bool)
        first[1:] = (corner[1:] != corner[:-1]) | (frame[1:] != frame[:-1])
        point, at = np.cumsum(first) - 1, np.flatnonzero(first)
        begins = np.flatnonzero(np.diff(frame[at], prepend=-1))
        owner = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(at)))
        order = np.argsort(cam, kind="stable")
        ends = np.flatnonzero(np.diff(cam[order], append=-1)) + 1
        parts = [order[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        return cls(tuple((int(cam[p[0]]), p, point[p], uv[p, 0], uv[p, 1]) for p in parts), point, np.ascontiguousarray(board[at].T), owner, begins)

    def _per_point(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, len(self.owner))

    def _per_frame(self, values: np.ndarray) -> np.ndarray:
        """Sums over the last axis, which is of points."""
        return np.add.reduceat(values, self.begins, axis=-1)

    def triangulated(self, rig: Rig) -> np.ndarray:
        """(3, N) points from all of their views (linear, radial distortion taken out)."""
        sums = [[np.zeros(len(self.owner)) for _ in range(i + 1)] for i in range(4)]
        for c, _, at, u, v in self.by_camera:
            a, b = (u - rig.centre[c, 0]) / rig.focal[c], (v - rig.centre[c, 1]) / rig.focal[c]
            grow, radial = rig.k1[c] * (a * a + b * b), np.ones(len(a))
            for _ in range(20):
                before, radial = radial, 1 / (1 + grow * radial * radial)
                if np.array_equal(before, radial):
                    break
            rows = np.column_stack((rig.turn[c], rig.shift[c]))[:, :, None]
            e, g = (a * radial) * rows[2] - rows[0], (b * radial) * rows[2] - rows[1]
            for i in range(4):
                for j in range(i + 1):
                    sums[i][j] += self._per_point(at, e[i] * e[j] + g[i] * g[j])
        last = _last_directions(sums)
        return last[:3] / last[3]

    def errors(self, rig: Rig) -> np.ndarray:
        """Errors in pixels of all views, at points triangulated with these cameras."""
        points, told = self.triangulated(rig), np.empty(len(self.point))
        for c, place, at, u, v in self.by_camera:
            _, _, a, b, _, radial = _toward(rig, c, points[:, at])
            told[place] = np.hypot(a * (rig.focal[c] * radial) + rig.centre[c, 0] - u, b * (rig.focal[c] * radial) + rig.centre[c, 1] - v)
        return told

    def board_poses(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(F, 3, 3) and (3, F): the rigid motions that take the board's places nearest to the points; null where a point is."""
        count = np.diff(self.begins, append=len(self.owner))
        mean_p, mean_b = self._per_frame(points) / count, self._per_frame(self.board) / count
        p, b = points - mean_p[:, self.owner], self.board - mean_b[:, self.owner]
        spread = np.stack([self._per_frame(p[i] * b) for i in range(3)]).transpose(2, 0, 1)
        lost = ~np.isfinite(spread).all(axis=(1, 2))
        u, _, w = np.linalg.svd(np.where(lost[:, None, None], 0.0, spread))
        u[:, :, 2] *= np.sign(np.linalg.det(u @ w))[:, None]
        turn = u @ w
        turn[lost] = np.nan
        return turn, mean_p - np.einsum("fij,jf->if", turn, mean_b)

    def solved(self, rig: Rig, stiffness: float, huber: float, rounds: int = 4):
        """The frames' points and boards' poses at these cameras, and at the last of them: each point's normal equations (three
        unknowns a point, with the six of its board) factored, those of the boards with the points eliminated, and the costs."""
        points = self.triangulated(rig)
        turn, shift = self.board_poses(points)
        n, size = len(self.owner), 3 * np.diff(self.begins, append=len(self.owner)) + 6
        square = stiffness * stiffness
        for k in range(rounds + 1):
            blocks = [[np.full(n, square) if i == j else np.zeros(n) for j in range(i + 1)] for i in range(3)]
            around = np.einsum("nij,jn->in", turn[self.owner], self.board)
            gap = stiffness * (points - around - shift[:, self.owner])
            pulls, cost = stiffness * gap, (gap * gap).sum(axis=0)
            views = []
            for c, _, at, u, v in self.by_camera:
                (eu, ev), (ju, jv), own = _slopes(rig, c, points[:, at], u, v, k == rounds)
                far = np.hypot(eu, ev)
                weight = np.where(far > huber, huber / np.maximum(far, 1e-300), 1.0)
                wu, wv = weight * ju, weight * jv
                for i in range(3):
                    for j in range(i + 1):
                        blocks[i][j] += self._per_point(at, wu[i] * ju[j] + wv[i] * jv[j])
                    pulls[i] += self._per_point(at, wu[i] * eu + wv[i] * ev)
                if k == rounds:
                    cost += self._per_point(at, np.where(far > huber, huber * (2 * far - huber), far * far))
                    views.append((c, at, own, (wu, wv), (eu, ev), weight))
            x, y, z = around
            zero, one = np.zeros(n), np.ones(n)
            # the gap by the board's turn and shift, without the stiffness
            lever = np.stack([np.stack(row) for row in ((zero, -z, y, -one, zero, zero), (z, zero, -x, zero, -one, zero), (-y, x, zero, zero, zero, -one))])
            levers = square * self._per_frame(np.einsum("ian,ibn->abn", lever, lever))
            trace = self._per_frame(blocks[0][0] + blocks[1][1] + blocks[2][2]) + np.einsum("aaf->f", levers)
            least = 1e-12 * trace / size
            for i in range(3):
                blocks[i][i] += least[self.owner]
            low, diagonal = _factored(blocks)
            by_board = np.stack(_forward(low, list(square * lever)))
            pulled = np.stack(_forward(low, list(pulls)))
            diagonal = np.stack(diagonal)
            over = by_board / diagonal[:, None]
            left = levers + least * np.eye(6)[:, :, None] - self._per_frame(np.einsum("ian,ibn->abn", over, by_board))
            slope = self._per_frame(stiffness * np.einsum("ian,in->an", lever, gap) - np.einsum("ian,in->an", over, pulled))
            left, slope = left.transpose(2, 0, 1), slope.T
            if k == rounds:
                break
            step = -np.linalg.solve(left, slope[:, :, None])[:, :, 0]
            rows = -(pulled + np.einsum("ian,na->in", by_board, step[self.owner])) / diagonal
            points = points + np.stack(_backward(low, list(rows)))
            turn, shift = turned(step[:, :3]) @ turn, shift + step[:, 3:].T
        return points, (low, diagonal, over, pulled, left, slope, views), self._per_frame(cost)

    def reduced(self, rig: Rig, stiffness: float, huber: float) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Normal equations of the cameras with the frames' unknowns eliminated, their slope, the cost and the number of frames,
        summed over all frames whose numbers are finite."""
        _, (low, diagonal, over, pulled, left, slope, views), cost = self.solved(rig, stiffness, huber)
        size, n = UNKNOWNS * len(rig.names), len(self.owner)
        cross = np.zeros((3, n, size))
        broken = ~(np.isfinite(pulled).all(axis=0) & np.isfinite(diagonal).all(axis=0) & np.isfinite(over).all(axis=(0, 1)))
        for c, at, own, weighted, _, _ in views:
            mine = slice(UNKNOWNS * c, UNKNOWNS * (c + 1))
            for i in range(3):
                for k in range(UNKNOWNS):
                    cross[i, :, mine.start + k] += self._per_point(at, weighted[0][i] * own[0][k] + weighted[1][i] * own[1][k])
            broken[at[~np.isfinite(own[0]).all(axis=0) | ~np.isfinite(own[1]).all(axis=0)]] = True
        fine = np.bincount(self.owner, broken, len(self.begins)) == 0
        fine &= np.isfinite(left).all(axis=(1, 2)) & np.isfinite(slope).all(axis=1) & np.isfinite(cost)
        keep = fine[self.owner]
        if not fine.all():
            cross[:, ~keep], over[:, :, ~keep], pulled[:, ~keep], diagonal[:, ~keep] = 0.0, 0.0, 0.0, 1.0
            low = [[np.where(keep, entry, 0.0) for entry in row] for row in low]
            left, slope = np.where(fine[:, None, None], left, np.eye(6)), np.where(fine[:, None], slope, 0.0)
        whole, pull = np.zeros((size, size)), np.zeros(size)
        for c, at, own, _, error, weight in views:
            mine = slice(UNKNOWNS * c, UNKNOWNS * (c + 1))
            counts = keep[at]
            if not counts.all():
                own, error, weight = [o[:, counts] for o in own], [e[counts] for e in error], weight[counts]
            for o, e in zip(own, error, strict=True):
                whole[mine, mine] += (o * weight) @ o.T
                pull[mine] += (o * weight) @ e
        rows = np.stack(_forward([[entry[:, None] for entry in row] for row in low], list(cross)))
        scaled = (rows / diagonal[:, :, None]).reshape(3 * n, size)
        whole -= scaled.T @ rows.reshape(3 * n, size)
        pull -= scaled.T @ pulled.ravel()
        by_board = -np.add.reduceat(over.transpose(2, 1, 0) @ rows.transpose(1, 0, 2), self.begins, axis=0)
        solved = np.linalg.solve(left, np.concatenate((by_board, slope[:, :, None]), axis=2)).reshape(-1, size + 1)
        flat = by_board.reshape(-1, size)
        return whole - flat.T @ solved[:, :-1], pull - flat.T @ solved[:, -1], float(cost[fine].sum()), int(fine.sum())


def packed_frames(views: DataFrame, board: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """by, views: one row a frame, of its corners that two cameras of the rig see. views: by, camera_id, corner_id, u, v; board:
    corner_id, bx, by (a fixed table, broadcast). Frames with under three such corners tell nothing of the board and go."""
    met = views.where(F.col("camera_id").isin(*names) & F.col("u").isNotNull() & F.col("v").isNotNull())
    met = met.join(F.broadcast(board.select("corner_id", F.col("bx").cast("double").alias("_bx"), F.col("by").cast("double").alias("_by"))), "corner_id")
    entry = F.struct("corner_id", "camera_id", "u", "v", "_bx", "_by")
    grouped = met.groupBy(*by).agg(F.array_sort(F.collect_set(entry)).alias("views"))
    like = lambda v, at: F.coalesce(F.get("views", at)["corner_id"] == v["corner_id"], F.lit(False))
    shared = F.filter("views", lambda v, at: like(v, at - 1) | like(v, at + 1))  # a corner's views stand beside each other
    kept = grouped.withColumn("views", shared)
    return kept.where(F.size(F.array_distinct(F.transform("views", lambda v: v["corner_id"]))) >= 3)


def _views(batch: pa.RecordBatch, number: dict[str, int]):
    """The views of `packed_frames`, FRAMES_AT_ONCE frames at a time: the batch's part, its views as one column, their corners,
    camera numbers, pixels and board's places as arrays, and where each frame's begin and end. Views never become Python objects one by one."""
    for at in range(0, len(batch), FRAMES_AT_ONCE):
        part = batch.slice(at, FRAMES_AT_ONCE)
        listed = part.column("views")
        flat, ends = listed.flatten(), np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False)).tolist()
        cameras = flat.field("camera_id").dictionary_encode()
        cam = np.array([number[n] for n in cameras.dictionary.to_pylist()], int)[cameras.indices.to_numpy()]
        values = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "_bx", "_by")]
        corner, uv, board = flat.field("corner_id").to_numpy(zero_copy_only=False), np.column_stack(values[:2]), np.column_stack((*values[2:], np.zeros(len(cam))))
        yield part, flat, (corner, cam, uv, board), list(zip([0, *ends[:-1]], ends, strict=True))


def _of_three(views: tuple[np.ndarray, ...], frame: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Views, in order of frames and corners, of the frames with three corners at least."""
    corner = views[0]
    first = np.ones(len(frame), bool)
    first[1:] = (corner[1:] != corner[:-1]) | (frame[1:] != frame[:-1])
    enough = (np.bincount(frame, first) >= 3)[frame]
    return tuple(v[enough] for v in views), frame[enough]


def scored(frames: DataFrame, rig: Rig, by: list[str], stiffness: float) -> DataFrame:
    """by, corner_id, views (camera_id, error in pixels) of every corner of `packed_frames`, at points triangulated with these cameras."""
    number = {name: n for n, name in enumerate(rig.names)}
    keys = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in by)
    kind = frames.schema["views"].dataType.elementType["corner_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for part, flat, views, bounds in _views(batch, number):
                owner = np.repeat(np.arange(len(bounds)), [hi - lo for lo, hi in bounds])
                sights = Frames.of(*views, owner)
                with np.errstate(all="ignore"):
                    errors = pa.array(sights.errors(rig), from_pandas=True)
                first = np.flatnonzero(np.diff(sights.point, prepend=-1))
                entries = pa.StructArray.from_arrays([flat.field("camera_id"), errors], ["camera_id", "error"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(owner[first])) for k in by), flat.field("corner_id").take(pa.array(first)), listed], [*by, "corner_id", "views"])

    return frames.mapInArrow(score, f"{keys}, corner_id {kind}, views array<struct<camera_id: string, error: double>>")


def _pair_errors(errors: DataFrame) -> DataFrame:
    """cam_a, cam_b, error: the mean of both for every two cameras that see a corner (a rig's cameras squared to a corner)."""
    one = errors.select(F.col("views").alias("all"), F.posexplode("views").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return two.select(F.col("a.camera_id").alias("cam_a"), F.col("b.camera_id").alias("cam_b"), ((F.col("a.error") + F.col("b.error")) / 2).alias("error"))


def camera_sums(frames: DataFrame, rig: Rig, stiffness: float, huber: float, limit: float | None = None, judge: Rig | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The summed normal equations of the cameras, their slope, the cost and the number of frames. Corners whose mean error over
    their views, with the cameras of `judge`, is `limit` or more do not count. Tasks add up their frames; Spark adds up the (rig-sized) sums of tasks."""
    number, size = {name: n for n, name in enumerate(rig.names)}, UNKNOWNS * len(rig.names)

    def add(batches):
        whole, slope, cost, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
        for batch in batches:
            for _, _, views, bounds in _views(batch, number):
                frame = np.repeat(np.arange(len(bounds)), [hi - lo for lo, hi in bounds])
                with np.errstate(all="ignore"):
                    if limit is not None:
                        seen = Frames.of(*views, frame)
                        good = (np.bincount(seen.point, seen.errors(judge)) / np.bincount(seen.point) < limit)[seen.point]
                        views, frame = tuple(v[good] for v in views), frame[good]
                    views, frame = _of_three(views, frame)
                    if len(frame):
                        a, b, c, m = Frames.of(*views, frame).reduced(rig, stiffness, huber)
                        whole, slope, cost, n = whole + a, slope + b, cost + c, n + m
        place = np.arange(size * size + size + 2, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate((whole.ravel(), slope, [cost, n])))], ["place", "value"])

    parts = frames.select("views").mapInArrow(add, "place int, value double")
    summed = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toPandas()["value"].to_numpy()
    if not len(summed):
        return np.zeros((size, size)), np.zeros(size), 0.0, 0
    return summed[: size * size].reshape(size, size), summed[size * size : -2], float(summed[-2]), int(round(summed[-1]))


def adjust(
    views: DataFrame, board: DataFrame, rig: Rig, by: list[str], stiffness: float, rounds: int = 10, start: float = 15.0, end: float = 1.0,
    huber: float = 50.0, enough: float = 0.3, steps: int = 3, pinned: int = 0,
) -> tuple[Rig, list[dict]]:
    """The rig whose cameras fit all views best, and one record a round (median error, limit, cost).

    Each round scores all views, and keeps the corners whose mean error is under a limit: the round's share of the way from
    `start` to `end` (even steps of the logarithm), but not over the largest 75th and not under the largest 15th percentile
    of any pair of cameras. Then up to `steps` damped Gauss-Newton passes over all kept corners, with Huber weights. It
    ends early where the median error is under `enough`. The camera `pinned` stays in its place. stiffness: weight of a unit
    of distance between a point and its board, in pixels. Passes: at most rounds * (2 + steps).
    """
    frames = cut(packed_frames(views, board, by, rig.names))
    free = np.ones(UNKNOWNS * len(rig.names), bool)
    free[UNKNOWNS * pinned : UNKNOWNS * pinned + 6] = False
    told, damping = [], 1e-9
    for limit in np.exp(np.linspace(np.log(start), np.log(end), rounds)).tolist():
        errors = cut(scored(frames, rig, by, stiffness))
        seen = F.filter(F.transform("views", lambda v: v["error"]), lambda e: e.isNotNull())
        means = errors.select((F.aggregate(seen, F.lit(0.0), lambda a, e: a + e) / F.nullif(F.size(seen), F.lit(0))).alias("error"))
        median = held_percentiles(means, [], "error", {"median": 0.5}).first()["median"]
        if median is None or median < enough:
            told.append({"median": median, "limit": limit, "cost": None})
            break
        lowest, highest = pair_percentiles(_pair_errors(errors), held=True).agg(F.max("low"), F.max("high")).first()
        limit = max(min(limit, limit if highest is None else highest), lowest or 0.0)
        judge = rig
        whole, slope, cost, n = camera_sums(frames, rig, stiffness, huber, limit, judge)
        for _ in range(steps if n else 0):
            a = whole[np.ix_(free, free)]
            step = np.zeros(len(free))
            step[free] = -np.linalg.solve(a + np.diag(damping * np.diag(a) + 1e-300), slope[free])
            tried = rig.moved(step)
            again = camera_sums(frames, tried, stiffness, huber, limit, judge)
            if again[3] >= n and again[2] <= cost:
                done = cost - again[2] < 1e-9 * cost
                rig, (whole, slope, cost, n), damping = tried, again, max(damping / 10, 1e-12)
                if done:
                    break
            else:
                damping *= 1000
        told.append({"median": median, "limit": limit, "cost": cost})
    return rig, told
