"""As-of joins: the row of another table that stands last before, first after or nearest to a moment.

Time is cut into blocks of `width`. A block's rows of both sides meet in one window; what came before the block is one
carried row, from a scan over one row a block. So a key that holds a third of all rows is spread over its blocks, no
row is searched for, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _met(left: DataFrame, right: DataFrame, by: list[str], t: str, columns: list[str], width: float, sign: int) -> DataFrame:
    """_row (a row of left), _b (its block), _found (struct of t and columns of right, or null). sign: 1 looks back, -1 ahead."""
    at = lambda c: sign * F.col(c).cast("double")
    block = F.floor(F.col("_t") / width)
    rows = left.select(*by, F.struct(*left.columns).alias("_row"), at(t).alias("_t")).withColumn("_b", block)
    value = F.struct(at(t).alias("_t"), *[F.col(c) for c in columns])
    others = right.where(F.col(t).isNotNull()).select(*by, value.alias("_value"), at(t).alias("_t")).withColumn("_b", block)
    last = others.groupBy(*by, "_b").agg(F.max("_value").alias("_value"))
    wanted = rows.select(*by, "_b").distinct().withColumn("_want", F.lit(True))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = last.withColumn("_want", F.lit(False)).unionByName(wanted, allowMissingColumns=True)
    blocks = blocks.groupBy(*by, "_b").agg(F.max("_value").alias("_value"), F.max("_want").alias("_want"))
    carried = blocks.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).where("_want and _value is not null")
    sides = (
        rows.withColumn("_side", F.lit(1))
        .unionByName(others.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        .unionByName(carried.select(*by, "_b", "_value", F.col("_value._t").alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True)
    )
    run = Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.withColumn("_found", F.when(F.col("_t").isNotNull(), F.last("_value", ignorenulls=True).over(run)))
    return found.where("_side = 1").select(*by, "_row", "_b", "_found")


def _columns(left: DataFrame, found: Column, columns: list[str], names: list[str], t_name: str, sign: int) -> list[Column]:
    return [
        *[F.col("_row").getField(c).alias(c) for c in left.columns],
        (sign * found.getField("_t")).alias(t_name),
        *[found.getField(c).alias(n) for c, n in zip(columns, names, strict=True)],
    ]


def asof(
    left: DataFrame, right: DataFrame, by: list[str], t: str, columns: list[str], width: float,
    tolerance: float | None = None, direction: str = "backward", prefix: str = "",
) -> DataFrame:
    """Every row of left with `columns` of the row of right of the same `by` that is last at or before its t (backward),
    first at or after it (forward), or nearer of both (nearest; at one distance, the one before); nulls if there is none
    within `tolerance`.

    right's t comes along as <prefix>t_found. Of rows of right at one t the one with the largest columns counts (forward
    the same). A null t finds nothing and is not found. width: length of a block, some hundred thousand rows of a key.
    """
    names, t_name = [f"{prefix}{c}" for c in columns], f"{prefix}{t}_found"
    if direction == "nearest":
        back = asof(left, right, by, t, columns, width, tolerance, "backward", "_back_")
        both = asof(back, right, by, t, columns, width, tolerance, "forward", "_ahead_")
        here, there = F.col(t) - F.col(f"_back_{t}_found"), F.col(f"_ahead_{t}_found") - F.col(t)
        ahead = F.coalesce(there < here, here.isNull())
        return both.select(
            *left.columns,
            *[F.when(ahead, F.col(f"_ahead_{c}")).otherwise(F.col(f"_back_{c}")).alias(n) for c, n in zip([f"{t}_found", *columns], [t_name, *names], strict=True)],
        )
    sign = {"backward": 1, "forward": -1}[direction]
    met = _met(left, right, by, t, columns, width, sign)
    found = F.col("_found")
    if tolerance is not None:
        gap = sign * F.col("_row").getField(t).cast("double") - F.col("_found._t")
        found = F.when(gap <= tolerance, found)
    return met.withColumn("_found", found).select(*_columns(left, F.col("_found"), columns, names, t_name, sign))


def frames_at(times: DataFrame, shown: DataFrame, by: list[str], tolerance: float, width: float) -> DataFrame:
    """The frame that each camera shows at the moments of `times`: by, t and frame, t_found (null where the last frame is
    older than `tolerance`). shown: by, t, frame, at each camera's own rate."""
    return asof(times, shown, by, "t", ["frame"], width, tolerance)
