"""Filters and gates over observations and triangulated points. NULL means "not observed".

A gate never rejects a row whose measure is null: NOT coalesce(measure > limit, false).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confidence(obs: DataFrame, least: float) -> DataFrame:
    """x, y become null where visibility is under `least`; the row stays."""
    seen = F.col("visibility") >= least
    return obs.withColumns({c: F.when(seen, F.col(c)) for c in ("x", "y")})


def visible(obs: DataFrame) -> DataFrame:
    return obs.withColumns({c: F.when(F.col("visibility") > 0, F.col(c)) for c in ("x", "y")})


def stage_points(obs: DataFrame, first: int) -> DataFrame:
    """The first points of a stage (point: 0, 1 ...), null where they were not seen."""
    return visible(obs.where(F.col("point") < first))


def seen_by(obs: DataFrame, least: int = 2, by: tuple[str, ...] = ("frame", "keypoint")) -> DataFrame:
    """Observations of points that at least `least` cameras see (x is not null); by join, as an aggregate is smaller than a
    window over all observations."""
    enough = obs.where("x is not null").groupBy(*by).agg(F.count("*").alias("n_cameras")).where(F.col("n_cameras") >= least)
    return obs.where("x is not null").join(enough, list(by))


def mean_error(errors: DataFrame, least: int = 2, by: tuple[str, ...] = ("frame", "keypoint")) -> DataFrame:
    """Mean error over cameras of each point; null below `least` valid cameras."""
    n = F.count("error")
    return errors.groupBy(*by).agg(n.alias("n_cameras"), F.when(n >= least, F.avg("error")).alias("mean_error"))


def reprojection(points: DataFrame, limit: float = 60.0) -> DataFrame:
    """Points whose mean error is over `limit` lose their position; points without an error pass."""
    bad = F.coalesce(F.col("mean_error") > limit, F.lit(False))
    return points.withColumns({c: F.when(~bad, F.col(c)) for c in ("x", "y", "z")})


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the largest `order` of each key: an aggregate on structs, not a sort."""
    rest = [c for c in df.columns if c not in by and c != order]
    return df.groupBy(*by).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*by, "_r.*")


def merge(*layers: DataFrame, by: tuple[str, ...] = ("frame", "keypoint")) -> DataFrame:
    """Later layers win over earlier ones where they have a position."""
    ranked = [layer.where("x is not null").withColumn("_layer", F.lit(n)) for n, layer in enumerate(layers)]
    union = ranked[0]
    for layer in ranked[1:]:
        union = union.unionByName(layer)
    return latest(union, list(by), "_layer").drop("_layer")


def corners_valid(corners: DataFrame) -> DataFrame:
    """Charuco corners with a name, a positive visibility and an x; frames without any vanish with their rows."""
    return corners.where("corner_id is not null and visibility > 0 and x is not null")


def complete_markers(corners: DataFrame, by: tuple[str, ...] = ("frame", "marker"), needed: int = 4) -> DataFrame:
    whole = corners.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") == needed).drop("_n")
    return corners.join(whole, list(by), "left_semi")


def densify(points: DataFrame, schema: DataFrame, frames: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """A row for every keypoint of `schema` (keypoint, ord) in every frame; visibility 1 where there is a position.

    schema is a fixed list of names, broadcast to the frames.
    """
    grid = frames.select(*by).distinct().join(F.broadcast(schema))
    full = grid.join(points.select(*by, "keypoint", "x", "y", "z"), [*by, "keypoint"], "left")
    return full.withColumn("visibility", F.when(F.col("x").isNull(), 0.0).otherwise(1.0))


def canonical(points: DataFrame, mapping: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Tracker points to canonical ones by weights. mapping: tracker, canonical, weight (a small fixed table).

    A canonical point needs all of its parts.
    """
    size = mapping.groupBy("canonical").agg(F.count("*").alias("_parts"))
    joined = points.join(F.broadcast(mapping), points["keypoint"] == mapping["tracker"]).where("x is not null")
    summed = joined.groupBy(*by, "canonical").agg(
        *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("x", "y", "z")], F.count("*").alias("_n")
    )
    whole = summed.join(F.broadcast(size), "canonical").where("_n = _parts")
    return whole.select(*by, F.col("canonical").alias("keypoint"), "x", "y", "z")


def top_per_key(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def tracker_names(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical names back to the tracker's, for those that stand for one tracker point alone. mapping: as of `canonical`."""
    single = mapping.groupBy("canonical").agg(F.count("*").alias("_n"), F.first("tracker").alias("_name")).where("_n = 1")
    return points.join(F.broadcast(single), points["keypoint"] == single["canonical"]).withColumn("keypoint", F.col("_name")).select(*points.columns)


def renamed_by_rank(points: DataFrame, names: list[str], by: tuple[str, ...] = ("frame",), order: str = "index") -> DataFrame:
    """Points that have only a running index get the names of an outline in order of rank; points beyond the list go."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return points.withColumn("keypoint", F.get(F.array(*map(F.lit, names)), rank - 1)).where("keypoint is not null")


def gate_over_filter(filtered: DataFrame, gated: DataFrame, by: tuple[str, ...] = ("frame", "keypoint"), enabled: bool = False) -> DataFrame:
    """Smoothed positions, over which the gate's raw ones win where it has one, if it is enabled."""
    return merge(filtered, gated.select(*filtered.columns), by=by) if enabled else filtered


def with_area(rows: DataFrame) -> DataFrame:
    """Rows whose width and height are positive."""
    return rows.where("width > 0 and height > 0")


def at_least(rows: DataFrame, level: str, column: str = "level", levels: tuple[str, ...] = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")) -> DataFrame:
    """Log rows of a level or above; unknown levels go."""
    return rows.where(F.col(column).isin(*levels[levels.index(level) :]))


def overlay(points: DataFrame, scale_x: float, scale_y: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by, points (array of name, x, y in screen pixels, sorted by name) and their bounding box; points without position go."""
    seen = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = seen.select(*by, "keypoint", (F.col("x") * scale_x).alias("x"), (F.col("y") * scale_y).alias("y"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("keypoint").alias("name"), "x", "y"))).alias("points")
    return at.groupBy(*by).agg(listed, *[f(c).alias(n) for f, c, n in ((F.min, "x", "left"), (F.min, "y", "top"), (F.max, "x", "right"), (F.max, "y", "bottom"))])
