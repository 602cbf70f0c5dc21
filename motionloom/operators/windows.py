"""Ordered operators: rolling medians, derivatives, gap filling, stable runs. Event time throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_median_time(df: DataFrame, by: str, t: str, value: str, seconds: float, seed: float | None = None) -> DataFrame:
    """Median of the non-null values of the last `seconds`, the row and the far edge included; the seed where there is none."""
    window = Window.partitionBy(by).orderBy(t).rangeBetween(-seconds, 0)
    return df.withColumn("rolling", F.coalesce(F.percentile(value, F.lit(0.5)).over(window), F.lit(seed).cast("double")))


def rolling_last(df: DataFrame, by: str, order: list[str], value: str, n: int) -> DataFrame:
    """Count, mean and median of the last n rows."""
    window = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumns(
        {
            "rolling_n": F.count(value).over(window),
            "rolling_mean": F.avg(value).over(window),
            "rolling_median": F.percentile(value, F.lit(0.5)).over(window),
        }
    )


def derivatives(df: DataFrame, by: str, t: str, columns: list[str]) -> DataFrame:
    """Adds v_<c> and a_<c>: backward velocity, and acceleration over two uneven steps; null where a step is not positive."""
    order = Window.partitionBy(by).orderBy(t)
    df = df.withColumns({"_dt": F.col(t) - F.lag(t).over(order)})
    speed = {f"v_{c}": F.when(F.col("_dt") > 0, (F.col(c) - F.lag(c).over(order)) / F.col("_dt")) for c in columns}
    df = df.withColumns(speed).withColumn("_dt0", F.lag("_dt").over(order))
    both = (F.col("_dt") > 0) & (F.col("_dt0") > 0)
    gain = {
        f"a_{c}": F.when(both, (F.col(f"v_{c}") - F.lag(f"v_{c}").over(order)) / (0.5 * (F.col("_dt") + F.col("_dt0"))))
        for c in columns
    }
    return df.withColumns(gain).drop("_dt", "_dt0")


def fill_linear(df: DataFrame, by: str, t: str, columns: list[str]) -> DataFrame:
    """Nulls between two values become the line between them; at the ends the nearest value stays."""
    before = Window.partitionBy(by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col(t))
        t0, t1 = F.last(known, True).over(before), F.first(known, True).over(after)
        y0, y1 = F.last(c, True).over(before), F.first(c, True).over(after)
        line = F.when(t1 > t0, y0 + (y1 - y0) * (F.col(t) - t0) / (t1 - t0))
        filled[c] = F.coalesce(F.col(c), line, y0, y1)
    return df.withColumns(filled)


def board_motion(corners: DataFrame, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """by, frame, motion of every frame but a recording's last: median displacement of the corners seen in it and in the
    next one; infinite with under `least` of them, as where the next frame is missing."""
    order = Window.partitionBy(*by, "corner_id").orderBy("frame")
    nxt = {f"_{c}": F.lead(c).over(order) for c in ("frame", "x", "y", "z")}
    square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in ("y", "z")), (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")))
    moved = corners.withColumns(nxt).withColumn("_d", F.when(F.col("_frame") == F.col("frame") + 1, F.sqrt(square)))
    grouped = moved.groupBy(*by, "frame").agg(F.percentile("_d", F.lit(0.5)).alias("_m"), F.count("_d").alias("_n"))
    ends = corners.groupBy(*by).agg(F.max("frame").alias("_last"))
    inner = (grouped.join(ends, list(by)) if by else grouped.join(F.broadcast(ends))).where(F.col("frame") < F.col("_last"))
    return inner.select(*by, "frame", F.when(F.col("_n") >= least, F.col("_m")).otherwise(float("inf")).alias("motion"))


def stable_runs(motion: DataFrame, by: str, order: str, limit: float, least: int) -> DataFrame:
    """The longest run of transitions under `limit` of each key, as start, n_frames (transitions + 1), mean_motion.

    Gaps and islands; of equally long runs the calmest, then the first. Keys without a run of `least` frames are absent.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    calm = motion.withColumn("_i", rank).where(F.col("motion") < limit)
    island = F.col("_i") - F.row_number().over(Window.partitionBy(by).orderBy(order))
    runs = calm.withColumn("_g", island).groupBy(by, "_g").agg(
        F.min(order).alias("start"), (F.count("*") + 1).alias("n_frames"), F.avg("motion").alias("mean_motion")
    ).where(F.col("n_frames") >= least)
    best = F.min(F.struct((-F.col("n_frames")).alias("_k"), "mean_motion", "start")).alias("_b")
    return runs.groupBy(by).agg(best).select(by, F.col("_b.start").alias("start"), (-F.col("_b._k")).alias("n_frames"), F.col("_b.mean_motion").alias("mean_motion"))


def corner_medians(corners: DataFrame, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """by, corner_id, x, y, z: component-wise medians of corners seen at least `least` times."""
    middle = [F.percentile(c, F.lit(0.5)).alias(c) for c in ("x", "y", "z")]
    return corners.groupBy(*by, "corner_id").agg(F.count("x").alias("_n"), *middle).where(F.col("_n") >= least).drop("_n")
