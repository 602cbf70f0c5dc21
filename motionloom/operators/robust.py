"""Robust means of rigid motions, of many pairs of cameras at once.

Ward clusters over whitened turns and shifts find each pair's largest mode; its mean is then refined by the transforms
whose turn is near, under ever narrower limits. Sums over transforms are Spark aggregates per pair; what one task holds of
a pair are cells of like transforms (single ones where they are few), of a bounded number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boards import POSE, turned
from .lineage import cut

#: Limits on the largest difference of a turn's entries, and the change of a mean at which refinement ends.
LIMITS = (0.5, 0.3, 0.15, 0.1)
JUMP = 10.0
#: So many cells of a pair are clustered; sides of cells are 0.25, 0.5, 1 ... standard deviations.
MOST_CELLS = 2000
SIDES = [0.25 * 2**k for k in range(16)]
TURN, FEATURES = POSE[:9], ["v0", "v1", "v2", "t0", "t1", "t2"]


def vectors(turns: np.ndarray) -> np.ndarray:
    """Rotation vectors (N, 3) of (N, 3, 3), also of half turns."""
    s = 0.5 * np.stack((turns[:, 2, 1] - turns[:, 1, 2], turns[:, 0, 2] - turns[:, 2, 0], turns[:, 1, 0] - turns[:, 0, 1]), axis=1)
    sine, cosine = np.linalg.norm(s, axis=1), (np.trace(turns, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sine, cosine)
    out = s * np.where(sine > 1e-12, angle / np.maximum(sine, 1e-300), 1.0)[:, None]
    half = np.flatnonzero((cosine < 0) & (sine < 1e-4))
    if len(half):
        axis = np.linalg.eigh((turns[half] + turns[half].transpose(0, 2, 1)) / 2)[1][:, :, -1]
        axis *= np.where((axis * s[half]).sum(axis=1) < 0, -1, 1)[:, None]
        out[half] = axis * angle[half][:, None]
    return out


def ward(x: np.ndarray, w: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of `clusters` Ward clusters of points x (N, D) that stand for w points each, by chains of nearest neighbours."""
    n = len(x)
    at, weight, alive = x.astype(float).copy(), w.astype(float).copy(), np.ones(n, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(alive.argmax()))
        i = chain[-1]
        gap = weight * weight[i] / (weight + weight[i]) * ((at - at[i]) ** 2).sum(axis=1)
        gap[~alive], gap[i] = np.inf, np.inf
        j = int(gap.argmin())
        if len(chain) > 1 and gap[chain[-2]] <= gap[j]:
            j = chain[-2]
            chain = chain[:-2]
            merges.append((float(gap[j]), i, j))
            at[j] = (at[i] * weight[i] + at[j] * weight[j]) / (weight[i] + weight[j])
            weight[j] += weight[i]
            alive[i] = False
        else:
            chain.append(j)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        root[find(i)] = find(j)
    return np.array([find(i) for i in range(n)])


def _matrices(means: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """POSE columns of FEATURES columns, with `more` of them kept."""
    kept = [*by, *more]
    schema = ", ".join(f"`{k}` {means.schema[k].dataType.simpleString()}" for k in kept) + ", " + ", ".join(f"{c} double" for c in POSE)

    def build(batches):
        for batch in batches:
            turn = turned(batch[["v0", "v1", "v2"]].to_numpy(float)).reshape(-1, 9)
            told = np.column_stack((turn, batch[["t0", "t1", "t2"]].to_numpy(float)))
            yield batch[kept].join(pd.DataFrame(told, columns=POSE, index=batch.index))

    return means.select(*kept, *FEATURES).mapInPandas(build, schema)


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with n (of the pair), w0 to w5 (whitened features) and cell (array): the transform alone, or a cube of the smallest
    side that gives the pair MOST_CELLS cells at most."""
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.stddev_pop(c).alias(f"_{c}") for c in FEATURES])
    white = [(F.col(c) / F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(1.0)).alias(f"w{k}") for k, c in enumerate(FEATURES)]
    rows = rows.join(whole, by).select(*rows.columns, "n", *white)
    cube = lambda side: F.array(*[F.floor(F.col(f"w{k}") / side).cast("long") for k in range(6)])
    many = rows.where(F.col("n") > MOST_CELLS).select(*by, *[f"w{k}" for k in range(6)], F.explode(F.array(*map(F.lit, SIDES))).alias("side"))
    counts = many.select(*by, "side", cube(F.col("side")).alias("cell")).distinct().groupBy(*by, "side").agg(F.count("*").alias("m"))
    chosen = counts.where((F.col("m") <= MOST_CELLS) | (F.col("side") == SIDES[-1])).groupBy(*by).agg(F.min("side").alias("side"))
    met = rows.join(chosen, by, "left")
    return met.withColumn("cell", F.when(F.col("side").isNull(), F.array("_id")).otherwise(cube(F.col("side")))).drop("side")


def _modes(celled: DataFrame, by: list[str]) -> DataFrame:
    """by, v0 to t2: the mean of each pair's largest cluster; of equal ones that with the smallest cell."""
    cells = celled.groupBy(*by, "cell").agg(F.count("*").alias("m"), F.first("n").alias("n"), *[F.avg(f"w{k}").alias(f"w{k}") for k in range(6)], *[F.sum(c).alias(c) for c in FEATURES])

    def mode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(cell=[tuple(c) for c in rows["cell"]]).sort_values("cell").reset_index(drop=True)
        n, m = int(rows["n"].iloc[0]), rows["m"].to_numpy(float)
        if n > 3:
            label = ward(rows[[f"w{k}" for k in range(6)]].to_numpy(float), m, max(n // 10, 3))
            sizes = {k: (-m[label == k].sum(), int((label == k).argmax())) for k in set(label.tolist())}
            rows = rows[label == min(sizes, key=sizes.get)]
        told = {c: [rows[c].sum() / rows["m"].sum()] for c in FEATURES}
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in by}, **told})

    schema = ", ".join(f"`{k}` {celled.schema[k].dataType.simpleString()}" for k in by) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    return cells.groupBy(*by).applyInPandas(mode, schema)


def _step(rows: DataFrame, current: DataFrame, by: list[str], limit: float) -> DataFrame:
    """POSE of the next mean of every pair of `current` (by, POSE): of the transforms with a difference under `limit`; where
    there is none, of the nearer half, three at least."""
    named = current.select(*by, *[F.col(c).alias(f"_{c}") for c in TURN])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in TURN])
    met = rows.join(named, by).select(*by, "_id", *FEATURES, gap.alias("gap"))
    near = F.col("gap") < limit
    means = met.groupBy(*by).agg(F.count_if(near).alias("kept"), *[F.avg(F.when(near, F.col(c))).alias(c) for c in FEATURES])
    means = cut(means)
    lost = means.where("kept = 0").select(*by)
    if not lost.isEmpty():
        one = Window.partitionBy(*by)
        ranked = met.join(lost, by, "left_semi").withColumns({"rank": F.row_number().over(one.orderBy("gap", "_id")), "m": F.count("*").over(one)})
        half = ranked.where(F.col("rank") <= F.greatest(F.floor(F.col("m") / 2), F.lit(3)))
        means = means.where("kept > 0").drop("kept").unionByName(half.groupBy(*by).agg(*[F.avg(c).alias(c) for c in FEATURES]))
    return _matrices(means, by, [])


def _change(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """b's columns and `change`, the largest difference of an entry from a's."""
    named = a.select(*by, *[F.col(c).alias(f"_{c}") for c in POSE])
    return b.join(named, by).withColumn("change", F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in POSE])).select(*b.columns, "change")


def mean_transforms(transforms: DataFrame, by: list[str], rounds: int = 3, settled: float = 0.001) -> DataFrame:
    """by, r00 to r22, t0 to t2: the robust mean of each pair's transforms. transforms: by and the same columns, many rows a pair.

    Rows with a null are left out. A pair's refinement ends where a limit moves its mean by more than JUMP; under one limit
    it is done again `rounds` times at most, until it moves by less than `settled`.
    """
    whole = transforms.select(*by, *POSE).dropna(subset=POSE).withColumn("_id", F.monotonically_increasing_id())
    schema = whole.select(*by, *TURN, "_id").schema.simpleString()[7:-1].replace(":", " ") + ", " + ", ".join(f"{c} double" for c in FEATURES)

    def measure(batches):
        for batch in batches:
            v = vectors(batch[TURN].to_numpy(float).reshape(-1, 3, 3))
            told = np.column_stack((v, batch[["t0", "t1", "t2"]].to_numpy(float)))
            yield batch[[*by, *TURN, "_id"]].join(pd.DataFrame(told, columns=FEATURES, index=batch.index))

    rows = cut(whole.mapInPandas(measure, schema))
    found = cut(_matrices(_modes(_cells(rows, by), by), by, []))
    going, ended = found, None
    for limit in LIMITS:
        now, settled_ = going, None
        for k in range(rounds):
            told = cut(_change(now, _step(rows, now, by, limit), by))
            calm = told if k + 1 == rounds else told.where(F.col("change") < settled)
            settled_ = calm.drop("change") if settled_ is None else settled_.unionByName(calm.drop("change"))
            now = told.where(F.col("change") >= settled).drop("change")
            if now.isEmpty():
                break
        moved = cut(_change(going, settled_, by))
        far = moved.where(F.col("change") > JUMP).select(*by)
        stopped = going.join(far, by, "left_semi")  # these keep the mean they had
        ended = stopped if ended is None else ended.unionByName(stopped)
        going = moved.where(F.col("change") <= JUMP).drop("change")
    return ended.unionByName(going)
