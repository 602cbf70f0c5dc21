"""Rigid skeletons of long recordings: bone lengths learnt from measured points, and the step of `temporal.Rigid` in blocks.

The step carries one direction a bone from frame to frame. A block of frames hands few of its frames on: those that its
last directions follow from. The serial step over these alone gives the directions at the start of every block; with
them all blocks are done by themselves. So one recording is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import Rigid, tree_order

Bones = list[tuple[str, str, float]]


def rolling_blocks(df: DataFrame, by: list[str], t: str, value: str, seconds: float, width: float, seed: str | None = None) -> DataFrame:
    """Adds `rolling`: the median of the non-null values of the last `seconds`, both ends included, to the microsecond; the column `seed` where
    there is none. A series is cut into blocks of `width` seconds (`seconds` at least); rows that a later block looks back
    on go to that block too."""
    width = max(width, seconds)
    block = F.floor(F.col(t) / width)
    reached = F.sequence(block, F.floor((F.col(t) + seconds) / width))
    spread = df.withColumn("_home", block).withColumn("_b", F.explode(reached))
    window = Window.partitionBy(*by, "_b").orderBy(F.round(F.col(t) * 1_000_000).cast("long")).rangeBetween(-round(seconds * 1_000_000), 0)
    rolled = spread.withColumn("rolling", F.percentile(value, F.lit(0.5)).over(window)).where("_b = _home").drop("_b", "_home")
    return rolled.withColumn("rolling", F.coalesce("rolling", seed)) if seed else rolled


def measured_lengths(points: DataFrame, bones: DataFrame, by: list[str], seconds: float = 10.0, width: float = 600.0) -> DataFrame:
    """by, frame, t, parent, child, length of every bone in every frame: the median of what was measured in the last `seconds`,
    else the seed. points: by, frame, t, keypoint, x, y, z, is_predicted; a length counts where both ends were measured.
    bones: parent, child, seed (a body's few rows, broadcast)."""
    good = F.when(F.col("x").isNotNull() & ~F.coalesce("is_predicted", F.lit(False)), F.struct("x", "y", "z"))
    frames = points.groupBy(*by, "frame").agg(
        F.min("t").alias("t"), F.map_from_entries(F.collect_list(F.when(good.isNotNull(), F.struct("keypoint", good.alias("at"))))).alias("_at")
    )
    each = frames.join(F.broadcast(bones.select("parent", "child", "seed")))
    a, b = F.try_element_at("_at", F.col("parent")), F.try_element_at("_at", F.col("child"))
    gap = F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("y", "z")), (a["x"] - b["x"]) * (a["x"] - b["x"])))
    each = each.select(*by, "frame", "t", "parent", "child", "seed", F.when(gap > 0, gap).alias("_length"))
    rolled = rolling_blocks(each, [*by, "parent", "child"], "t", "_length", seconds, width, "seed")
    return rolled.select(*by, "frame", "t", "parent", "child", F.col("rolling").alias("length"))


def _needed(frames: list[tuple[dict, dict]], bones: Bones, root: str) -> dict[int, set[str]]:
    """Which of a block's frames, and which children in them, decide its last directions, whatever those at its start are."""
    above = {}
    for parent, child, _ in bones:
        above[child] = [*above.get(parent, []), (parent, child)]
    last, at = {}, {(p, c): -1 for p, c, _ in bones}  # directions (absent: as at the start) and the frame each is from
    came, open_, wanted = [], set(), set()
    for n, (points, lengths) in enumerate(frames):
        held = {root: points[root]} if root in points else {}
        for parent, child, length in bones:
            length = lengths.get((parent, child), length)
            if parent not in held or length <= 0:
                continue
            bone, start = (parent, child), held[parent]
            if child in points:
                way = None if start is None else points[child] - start
                size = None if way is None else float(np.linalg.norm(way))
                if size is None:  # depends on the start of the block: this frame and what was before it are needed
                    open_.add((bone, n))
                    wanted.add((bone, at[bone]))
                    last[bone], at[bone] = None, n
                elif size > 1e-6:
                    last[bone], at[bone] = way / size, n
            way = last.get(bone)
            held[child] = None if way is None or start is None else start + length * way
        came.append(dict(at))
    wanted |= {*at.items(), *open_}
    done = set()
    while wanted:
        bone, n = wanted.pop()
        if n < 0 or (bone, n) in done:
            continue
        done.add((bone, n))
        wanted |= {(a, came[n][a]) for a in above[bone[1]][:-1]}
    decide: dict[int, set[str]] = {}
    for (_, child), n in done:
        decide.setdefault(n, {root}).add(child)
    return decide or {len(frames) - 1: {root}}


def _read(at, lengths) -> tuple[dict, dict]:
    return {k: np.array([v["x"], v["y"], v["z"]]) for k, v in dict(at).items()}, {} if lengths is None else {(v["parent"], v["child"]): v["length"] for v in lengths}


def rigid_blocks(points: DataFrame, bones: Bones, root: str, by: list[str], lengths: DataFrame | None = None, block_frames: int = 4096) -> DataFrame:
    """by, frame, keypoint, x, y, z of rigid skeletons, as `temporal.rigidify` gives them, in blocks of `block_frames`.

    points: by, frame, keypoint, x, y, z (one row a keypoint and frame). lengths: by, frame, parent, child, length in place of
    those of `bones`, as of `measured_lengths`. Recordings of any length; only the frames that blocks hand on (some to a
    bone) are walked through in order.
    """
    bones = tree_order(bones, root)
    entry = F.struct("keypoint", F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")]).alias("at"))
    frames = points.where("x is not null").groupBy(*by, "frame").agg(F.map_from_entries(F.collect_list(entry)).alias("at"))
    if lengths is None:
        frames = frames.withColumn("lengths", F.lit(None).cast("array<struct<parent:string,child:string,length:double>>"))
    else:
        of_frame = lengths.groupBy(*by, "frame").agg(F.collect_list(F.struct("parent", "child", F.col("length").cast("double").alias("length"))).alias("lengths"))
        frames = frames.join(of_frame, [*by, "frame"], "left")
    frames = frames.withColumn("_b", F.floor(F.col("frame") / block_frames))
    keys = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in [*by, "_b"])

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame").reset_index(drop=True)
        decide = _needed([_read(a, n) for a, n in zip(rows["at"], rows["lengths"], strict=True)], bones, root)
        few = rows.iloc[sorted(decide)].copy()
        few["at"] = [{k: v for k, v in dict(a).items() if k in decide[n]} for n, a in zip(sorted(decide), few["at"], strict=True)]
        return few

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        body, out = Rigid(bones, root), []
        for block, part in rows.sort_values(["_b", "frame"]).groupby("_b", sort=True):
            out.append((*part[by].iloc[0], block, *_carried(body)))
            for at, given in zip(part["at"], part["lengths"], strict=True):
                body.step(*_read(at, given))
        return pd.DataFrame(out, columns=[*by, "_b", "parents", "children", "ways"])

    kept = frames.groupBy(*by, "_b").applyInPandas(thin, frames.schema)
    carried = kept.groupBy(*by).applyInPandas(scan, f"{keys}, parents array<string>, children array<string>, ways array<array<double>>")

    def run(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        body, out = Rigid(bones, root), []
        for row in start.itertuples(index=False):
            body.last = {(p, c): np.array(w, float) for p, c, w in zip(row.parents, row.children, row.ways, strict=True)}
        for row in rows.sort_values("frame").to_dict("records"):
            out += [(*[row[k] for k in by], row["frame"], k, *p) for k, p in body.step(*_read(row["at"], row["lengths"])).items()]
        return pd.DataFrame(out, columns=[*by, "frame", "keypoint", "x", "y", "z"])

    names = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*by, "frame", "keypoint"])
    return frames.groupBy(*by, "_b").cogroup(carried.groupBy(*by, "_b")).applyInPandas(run, f"{names}, x double, y double, z double")


def _carried(body: Rigid) -> tuple[list, list, list]:
    return [p for p, _ in body.last], [c for _, c in body.last], [w.tolist() for w in body.last.values()]
