"""Stateful filters over time: One Euro, prediction of lost keypoints, velocity gate, rigid skeletons.

Each filter is one step function on a small state; batches run it per key over rows in order of time
(in sorted partitions, see `runs`), streams hand the same step to a stateful operator (streaming.filters). A key is one
keypoint of one recording, so that keys are many and short against a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs


@dataclass
class OneEuro:
    """Low-pass filter whose cutoff grows with speed (Casiez et al. 2012), for a vector."""

    min_cutoff: float = 1.0
    beta: float = 0.0
    d_cutoff: float = 1.0
    t: float | None = None
    x: np.ndarray | None = None
    dx: np.ndarray | None = None

    def step(self, t: float, x: np.ndarray) -> np.ndarray:
        """A row without an observation (null) stays null and leaves the state as it is."""
        if np.isnan(x).any():
            return np.full_like(x, np.nan)
        if self.t is None:
            self.t, self.x, self.dx = t, x, np.zeros_like(x)
            return x
        dt = t - self.t
        if dt <= 0:
            raise ValueError(f"time must grow: {self.t} then {t}")
        blend = lambda cutoff: 1 / (1 + 1 / (2 * math.pi * cutoff * dt))
        speed = blend(self.d_cutoff)
        self.dx = speed * (x - self.x) / dt + (1 - speed) * self.dx
        a = blend(self.min_cutoff + self.beta * np.abs(self.dx))
        self.x, self.t = a * x + (1 - a) * self.x, t
        return self.x

    def drift(self, t: float, decay: float) -> np.ndarray:
        """Moves on at the filtered velocity, which decays."""
        self.x, self.t, self.dx = self.x + self.dx * (t - self.t), t, self.dx * decay
        return self.x


@dataclass
class Predicting:
    """One Euro that fills up to `most` frames in a row without an observation (null)."""

    filter: OneEuro = field(default_factory=OneEuro)
    most: int = 3
    decay: float = 0.5
    lost: int = 0

    def step(self, t: float, x: np.ndarray) -> tuple[np.ndarray | None, bool]:
        """Position and whether it is predicted."""
        backwards = self.filter.t is not None and t <= self.filter.t
        if not np.isnan(x).any():
            self.lost = 0
            return (x if backwards else self.filter.step(t, x)), False  # a frame out of order passes as it is
        if self.filter.t is None or backwards or self.lost >= self.most:
            return None, False
        self.lost += 1
        return self.filter.drift(t, self.decay), True


@dataclass
class VelocityGate:
    """Holds the last accepted position while the implied velocity is over the limit, at most `streak` times in a row.

    Velocity is the distance from the last accepted position over the time since the previous frame of the recording,
    whether or not the keypoint was seen in it."""

    limit: float
    streak: int = 5
    t: float | None = None
    x: np.ndarray | None = None
    rejected: int = 0

    def step(self, t: float, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """Position and whether it is held."""
        dt = None if self.t is None else t - self.t
        if dt is not None and dt <= 0:
            raise ValueError(f"time must grow: {self.t} then {t}")
        self.t = t
        return self.after(dt, x)

    def after(self, dt: float | None, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """As step, with the time since the previous frame given. A row without an observation (null) stays null: it moves the
        clock alone and neither holds, nor counts as a rejection, nor is accepted."""
        if np.isnan(x).any():
            return np.full_like(x, np.nan), False
        if self.x is None or dt is None or self.rejected >= self.streak or float(np.linalg.norm(x - self.x)) / dt <= self.limit:
            self.x, self.rejected = x, 0
            return x, False
        self.rejected += 1
        return self.x, True


def over_time(df: DataFrame, by: list[str], t: str, columns: list[str], step: Callable, flag: str | None, order: list[str] | None = None) -> DataFrame:
    """Runs a step function per key in order of t. `step()` makes a function (t, vector) -> vector or (vector or None, flag).
    Keys follow each other in sorted partitions; a key's state goes on from batch to batch, so that no key is held whole."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    schema += "".join(f", `{c}_out` double" for c in columns) + (f", `{flag}` boolean" if flag else "")
    kept, names = df.columns, [*df.columns, *(f"{c}_out" for c in columns), *([flag] if flag else [])]

    def run(batches):
        advance = None
        for batch in batches:
            first = batch.column(runs.FIRST).to_pylist()
            x, out, flags = np.column_stack([runs.numbers(batch, c) for c in columns]), np.full((len(batch), len(columns)), np.nan), []
            for i, now in enumerate(runs.numbers(batch, t).tolist()):
                if first[i]:
                    advance = step()
                got = advance(now, x[i])
                value, marked = got if flag else (got, False)
                if value is not None:
                    out[i] = value
                flags.append(marked)
            told = [batch.column(c) for c in kept] + [pa.array(out[:, k], from_pandas=True) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*told, pa.array(flags, pa.bool_())] if flag else told, names)

    return runs.sorted_keys(df, by, order or [t]).mapInArrow(run, schema)


def one_euro(df: DataFrame, by: list[str], t: str, columns: list[str], **config) -> DataFrame:
    return over_time(df, by, t, columns, lambda: OneEuro(**config).step, None)


def predict_lost(df: DataFrame, by: list[str], t: str, columns: list[str], most: int = 3, decay: float = 0.5, **config) -> DataFrame:
    """Needs a row per frame, with nulls where the keypoint was not seen."""
    return over_time(df, by, t, columns, lambda: Predicting(OneEuro(**config), most, decay).step, "is_predicted")


def frame_clock(df: DataFrame, recording: list[str], t: str) -> DataFrame:
    """Adds _dt: time since the previous frame of the recording, over all of its rows; null in the first."""
    frames = df.select(*recording, t).distinct()
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*recording).orderBy(t))
    return df.join(frames.withColumn("_dt", step), [*recording, t])


def velocity_gate(df: DataFrame, by: list[str], t: str, columns: list[str], limit: float, streak: int = 5, recording: list[str] | None = None) -> DataFrame:
    """Rows of `by` are one keypoint; `recording` names the keys of what shares a frame clock (all of `by` if not given)."""
    clocked = frame_clock(df, recording or by, t).select(*df.columns, "_dt")
    return over_time(clocked, by, "_dt", columns, lambda: VelocityGate(limit, streak).after, "is_held", [t]).drop("_dt")


def low_pass(x: np.ndarray, rate: float, cutoff: float, order: int = 4, left: int | None = None, right: int | None = None) -> np.ndarray:
    """Zero-phase Butterworth low-pass of a series, as the squared magnitude response applied to its odd extension.

    left, right: samples by which the ends are extended; if not given, so many that the response has died away."""
    n = len(x)
    if n < 3 or np.isnan(x).any():
        return x if n < 3 else np.full(n, np.nan)
    warped = 2 * math.tan(math.pi * min(cutoff / rate, 0.499))
    far = math.ceil(30 / (warped * math.sin(math.pi / (2 * order)))) + 8
    left, right = min(n - 1, far if left is None else left), min(n - 1, far if right is None else right)
    wide = np.concatenate((2 * x[0] - x[left:0:-1], x, 2 * x[-1] - x[-2 : -right - 2 : -1]))
    f = np.fft.rfftfreq(len(wide), 1 / rate)
    warp = np.tan(np.pi * np.minimum(f, rate / 2 * 0.999999) / rate) / np.tan(np.pi * cutoff / rate)
    return np.fft.irfft(np.fft.rfft(wide) / (1 + warp ** (2 * order)), len(wide))[left : left + n]


def smooth(df: DataFrame, by: list[str], t: str, columns: list[str], rate: float, cutoff: float, order: int = 4) -> DataFrame:
    """Replaces gap-free columns by their low-passed form, per key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t, kind="stable").reset_index(drop=True)
        for c in columns:
            rows[c] = low_pass(rows[c].to_numpy(float), rate, cutoff, order)
        return rows

    return df.groupBy(*by).applyInPandas(run, df.schema)


def curvatures(h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of a not-a-knot spline, from the widths and slopes of its pieces (two at least)."""
    rise = 6 * np.diff(slope)
    if len(h) == 2:  # one parabola
        return np.full(3, rise[0] / (3 * (h[0] + h[1])))
    low, middle, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # the end curvatures are on the line through the two next to them
    middle[0] += h[0] * (1 + h[0] / h[1])
    high[0] -= h[0] * h[0] / h[1]
    middle[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] * h[-1] / h[-2]
    low, middle, high, rise = low.tolist(), middle.tolist(), high.tolist(), rise.tolist()  # plain floats: many short series
    for i in range(1, len(middle)):
        share = low[i] / middle[i - 1]
        middle[i] -= share * high[i - 1]
        rise[i] -= share * rise[i - 1]
    inner = [0.0] * len(middle)
    inner[-1] = rise[-1] / middle[-1]
    for i in range(len(middle) - 2, -1, -1):
        inner[i] = (rise[i] - high[i] * inner[i + 1]) / middle[i]
    first = inner[0] + (inner[0] - inner[1]) * h[0] / h[1]
    last = inner[-1] + (inner[-1] - inner[-2]) * h[-1] / h[-2]
    return np.concatenate(([first], inner, [last]))


def spline_fill(df: DataFrame, by: list[str], t: str, columns: list[str]) -> DataFrame:
    """Fills nulls by the cubic spline through the values present whose first two and last two pieces are one cubic each
    (not-a-knot); ends keep the nearest value. A series takes time and memory in proportion to its length."""

    def fill(time: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(y)
        x, v = time[ok], y[ok]
        if len(x) < 3:
            return np.interp(time, x, v) if len(x) else y
        h, slope = np.diff(x), np.diff(v) / np.diff(x)
        m = curvatures(h, slope)
        at = np.clip(time, x[0], x[-1])
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
        a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
        return a * v[i] + b * v[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t, kind="stable").reset_index(drop=True)
        time = rows[t].to_numpy(float)
        for c in columns:
            rows[c] = fill(time - time[0], rows[c].to_numpy(float))
        return rows

    return df.groupBy(*by).applyInPandas(run, df.schema)


def tree_order(bones: list[tuple[str, str, float]], root: str) -> list[tuple[str, str, float]]:
    """Bones (parent, child, length) with parents before children."""
    below: dict[str, list] = {}
    for bone in bones:
        below.setdefault(bone[0], []).append(bone)
    found, queue = [], [root]
    while queue:
        for bone in below.get(queue.pop(0), []):
            found.append(bone)
            queue.append(bone[1])
    return found


class Rigid:
    """Holds bones at fixed lengths, from the root outwards, and fills lost points along their bone's last direction."""

    def __init__(self, bones: list[tuple[str, str, float]], root: str):
        self.bones, self.root, self.last = tree_order(bones, root), root, {}

    def step(self, points: dict[str, np.ndarray], lengths: dict[tuple[str, str], float] | None = None) -> dict[str, np.ndarray]:
        """lengths: of this frame, in place of those given at the start."""
        if self.root not in points:
            return {}
        held = {self.root: points[self.root]}
        for parent, child, length in self.bones:
            length = lengths.get((parent, child), length) if lengths else length
            if parent not in held or length <= 0:
                continue
            way = points[child] - held[parent] if child in points else np.zeros(3)
            size = float(np.linalg.norm(way))
            way = way / size if size > 1e-6 else self.last.get((parent, child), np.array([0.0, 1.0, 0.0]))
            self.last[parent, child] = way
            held[child] = held[parent] + length * way
        return held


def rigidify(points: DataFrame, bones: list[tuple[str, str, float]], root: str, by: list[str]) -> DataFrame:
    """by, frame, keypoint, x, y, z of rigid skeletons. points: by, frame, keypoint, x, y, z; a key is one body in one recording.

    The plain form: one task holds a key whole. Recordings of any length: `rigid.rigid_blocks`, which gives the same."""
    keys = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*by, "frame", "keypoint"])
    named = F.map_from_entries(F.collect_list(F.struct("keypoint", F.array("x", "y", "z"))))
    frames = points.where("x is not null").groupBy(*by, "frame").agg(named.alias("at"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        body, out = Rigid(bones, root), []
        for row in rows.sort_values("frame").itertuples(index=False):
            at = {k: np.array(v, float) for k, v in dict(row.at).items()}
            out += [(*row[: len(by)], row.frame, k, *p) for k, p in body.step(at).items()]
        return pd.DataFrame(out, columns=[*by, "frame", "keypoint", "x", "y", "z"])

    return frames.groupBy(*by).applyInPandas(run, f"{keys}, x double, y double, z double")
