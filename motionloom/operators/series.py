"""Splines and low-pass filters of long series, in blocks of time that overlap.

Both reach over a whole series, but their weights fall off: a cubic spline's second derivatives depend on a knot n knots
away with a factor under 2^-n (the system's diagonal is twice the sum of its neighbours), and the low-pass response falls
with the damping of its slowest pole. A block that also sees `HALO_KNOTS` knots, or `reach` samples, on both sides gives
what the whole series gives, to the last digits of a double. So a series that holds a third of all rows is spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .temporal import curvatures, low_pass

HALO_KNOTS = 64


def interpolate(time: np.ndarray, x: np.ndarray, v: np.ndarray, order: int) -> np.ndarray:
    """Values at `time` through the knots (x, v) in order: the last knot's value (order 0), lines (1), or the cubic spline whose
    first two and last two pieces are one cubic each (3); beyond the ends the nearest value stays. Too few knots lower the order."""
    if order not in (0, 1, 3):
        raise ValueError(f"order {order}: 0, 1 and 3 are offered")
    if not len(x):
        return np.full(len(time), np.nan)
    if order == 0:
        return v[np.clip(np.searchsorted(x, time, side="right") - 1, 0, len(x) - 1)]
    if order == 1 or len(x) < 3:
        return np.interp(time, x, v)
    h, slope = np.diff(x), np.diff(v) / np.diff(x)
    m = curvatures(h, slope)
    at = np.clip(time, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return a * v[i] + b * v[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6


def _edges(batches, by: list[str], t: str, columns: list[str]):
    """The first and last HALO_KNOTS values of each column of a block; a row without value for a block that has none."""
    for table, keys in runs.whole_keys(batches):
        for n, c in enumerate(columns):
            known, at = np.flatnonzero(~np.isnan(runs.numbers(table, c))), []
            cuts = np.searchsorted(known, [k for key in keys for k in key]).tolist()
            for (lo, _), i, j in zip(keys, cuts[::2], cuts[1::2], strict=True):
                at.append([lo] if i == j else known[i:j] if j - i <= 2 * HALO_KNOTS else known[[*range(i, i + HALO_KNOTS), *range(j - HALO_KNOTS, j)]])
            few = table.take(pa.array(np.concatenate(at)))
            told = [*(few.column(k) for k in [*by, "_b"]), pa.array(np.full(len(few), n, np.int32)), pa.array(runs.numbers(few, t)), pa.array(runs.numbers(few, c), from_pandas=True)]
            yield from pa.table(told, [*by, "_b", "_n", "_t", "_v"]).to_batches()


def _around(batches, by: list[str]):
    """For each block of a series, the last HALO_KNOTS values before it and the first behind it, among the edges of all of its blocks."""
    for table, keys in runs.whole_keys(batches):
        block, ok = table.column("_b").to_numpy(), ~np.isnan(runs.numbers(table, "_v"))
        known, at, goes = np.flatnonzero(ok), [], []
        for lo, hi in keys:
            own, wanted = known[np.searchsorted(known, lo) : np.searchsorted(known, hi)], np.unique(block[lo:hi])
            left, right = np.searchsorted(block[own], wanted), np.searchsorted(block[own], wanted, side="right")
            for b, i, j in zip(wanted.tolist(), left.tolist(), right.tolist(), strict=True):
                near = np.concatenate((own[max(0, i - HALO_KNOTS) : i], own[j : j + HALO_KNOTS]))
                at.append(near)
                goes.append(np.full(len(near), b))
        few = table.take(pa.array(np.concatenate(at)))
        told = [*(few.column(k) for k in by), pa.array(np.concatenate(goes), pa.int64()), *(few.column(c) for c in ("_n", "_t", "_v"))]
        yield from pa.table(told, [*by, "_b", "_n", "_t", "_v"]).to_batches()


def _filled(batches, names: list[str], t: str, columns: list[str], order: int):
    """Rows of blocks with their gaps filled from their own values and those around them."""
    for table, keys in runs.whole_keys(batches):
        home, time, near, value = table.column("_n").is_null().to_numpy(), runs.numbers(table, "_t"), runs.numbers(table, "_n"), runs.numbers(table, "_v")
        for n, c in enumerate(columns):
            y, all_y = runs.numbers(table, c), runs.numbers(table, c)
            knot = np.where(home, y, np.where(near == n, value, np.nan))
            gap, there = home & np.isnan(y), ~np.isnan(knot)
            for lo, hi in keys:
                if not gap[lo:hi].any():
                    continue
                start = time[lo:hi][home[lo:hi]][0]
                x, wanted = time[lo:hi] - start, gap[lo:hi]
                all_y[lo:hi][wanted] = interpolate(x[wanted], x[there[lo:hi]], knot[lo:hi][there[lo:hi]], order)
            kind = table.schema.field(c).type
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(all_y, from_pandas=True).cast(kind))
        yield from table.filter(pa.array(home)).select(names).to_batches()


def fill_blocks(df: DataFrame, by: list[str], t: str, columns: list[str], width: float, order: int = 3) -> DataFrame:
    """Nulls of `columns` filled from the values present, per series of `by`, in blocks of `width` of t.

    Each block's first and last HALO_KNOTS values of a column are told; a pass over these (at most two times HALO_KNOTS rows a
    block) gives every block the values before and behind it, however far away they are, as rows beside its own. Blocks follow
    each other in sorted partitions, so that many short series cost what their rows cost. Rows without t come back as they are.
    """
    if order not in (0, 1, 3):
        raise ValueError(f"order {order}: 0, 1 and 3 are offered")
    rows, names = df.where(F.col(t).isNotNull()).withColumn("_b", F.floor(F.col(t) / width)), df.columns
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    knots = f"{kind}, _b long, _n int, _t double, _v double"
    edges = runs.sorted_keys(rows.select(*by, "_b", t, *columns), [*by, "_b"], [t]).mapInArrow(lambda batches: _edges(batches, by, t, columns), knots)
    halos = runs.sorted_keys(edges, [*by, "_n"], ["_b", "_t"]).mapInArrow(lambda batches: _around(batches, by), knots)
    both = rows.withColumn("_t", F.col(t).cast("double")).unionByName(halos, allowMissingColumns=True)
    filled = runs.sorted_keys(both, [*by, "_b"], ["_t"]).mapInArrow(lambda batches: _filled(batches, names, t, columns, order), df.schema)
    return filled.unionByName(df.where(F.col(t).isNull()))


def reach(rate: float, cutoff: float, order: int) -> int:
    """Samples until the low-pass response has fallen by 10^-13."""
    warped = 2 * math.tan(math.pi * min(cutoff / rate, 0.499))
    return math.ceil(30 / (warped * math.sin(math.pi / (2 * order)))) + 8


def smooth_blocks(df: DataFrame, by: list[str], t: str, columns: list[str], rate: float, cutoff: float, order: int = 4, step: float = 1.0, block_samples: int = 65536) -> DataFrame:
    """Zero-phase Butterworth low-pass of gap-free series with a sample every `step` of t, in blocks that overlap by `reach`
    samples. Where a block's neighbours end, the series does: there it is extended oddly. A null in a block empties its column there."""
    halo, names = reach(rate, cutoff, order), df.columns
    width = step * max(block_samples, halo)
    edge = (halo + 0.5) * step
    block = F.floor(F.col(t) / width)
    wanted = F.sequence(F.floor((F.col(t) - edge) / width), F.floor((F.col(t) + edge) / width))
    spread = df.where(F.col(t).isNotNull()).withColumn("_home", block).withColumn("_b", F.explode(wanted))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t, kind="stable").reset_index(drop=True)
        home = (rows["_home"] == rows["_b"]).to_numpy()
        if not home.any():
            return rows.loc[home, names]
        lo = int(home.argmax())
        hi = len(home) - int(home[::-1].argmax())
        for c in columns:
            rows[c] = low_pass(rows[c].to_numpy(float), rate, cutoff, order, halo - min(lo, halo), halo - min(len(home) - hi, halo))
        return rows.loc[home, names]

    return spread.groupBy(*by, "_b").applyInPandas(run, df.schema)


def fill_and_smooth(df: DataFrame, by: list[str], t: str, columns: list[str], rate: float, cutoff: float, width: float, order: int = 4, spline: int = 3, step: float = 1.0, block_samples: int = 65536) -> DataFrame:
    """Gaps filled, then smoothed: what recordings go through after triangulation. Series without any value stay null."""
    return smooth_blocks(fill_blocks(df, by, t, columns, width, spline), by, t, columns, rate, cutoff, order, step, block_samples)
