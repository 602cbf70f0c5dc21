"""Calibration epochs: which version of a calibration holds for a frame, and when repeated failures end it.

A version holds from its loading to the next one. `most` failed frames in a row make it invalid until the next loading.
Filters that take the epoch among their keys begin anew with each loading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof

MOST_FAILURES = 10


def versioned(frames: DataFrame, versions: DataFrame, by: list[str], width: float) -> DataFrame:
    """frames (by, t and more) with `version` and `since`, its loading, of the version that holds at t; null before the first.

    versions: by, t, version."""
    return asof(frames, versions, by, "t", ["version"], width).withColumnRenamed("t_found", "since")


def epochs(frames: DataFrame, versions: DataFrame, by: list[str], width: float, most: int = MOST_FAILURES) -> DataFrame:
    """frames (by, frame, t, ok) with version, since, failures (in a row, this frame included; null before the first version) and status: none, valid, invalid.

    ok: whether the frame could be triangulated; null: not tried, which neither adds to a run of failures nor ends it. The
    frame whose failure is the `most`-th in a row is still valid, those behind it are invalid. Runs are counted over
    blocks of `width` seconds, with one carried row a block, so that a long recording is spread.
    """
    rows = versioned(frames, versions, by, width).withColumn("_b", F.floor(F.col("t") / width))
    epoch = [*by, "since"]
    block = [*epoch, "_b"]
    run = Window.partitionBy(*block).orderBy("t", "frame").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(run)
    rows = rows.withColumn("_failed", failed).withColumn("_at_ok", F.max(F.when(F.col("ok"), F.col("_failed"))).over(run))
    ends = rows.groupBy(*block).agg(F.max("_failed").alias("_n"), F.max("_at_ok").alias("_reset"))
    before = Window.partitionBy(*epoch).orderBy("_b")
    ends = ends.withColumn("_island", F.count("_reset").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*epoch, "_island").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_tail", F.sum(F.col("_n") - F.coalesce("_reset", F.lit(0))).over(inside))
    carried = ends.select(*block, F.coalesce(F.lag("_tail").over(before), F.lit(0)).alias("_carried"))
    counted = rows.join(carried, block, "left")  # rows before any version meet nothing
    failures = F.col("_failed") - F.coalesce("_at_ok", -F.coalesce("_carried", F.lit(0)))
    counted = counted.withColumn("failures", F.when(F.col("since").isNotNull(), failures).cast("long"))
    over = counted.groupBy(*block).agg(F.min(F.when(F.col("failures") >= most, F.col("t"))).alias("_over"))
    over = over.select(*block, F.min("_over").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("_over"))
    told = counted.join(over, block, "left")
    status = F.when(F.col("since").isNull(), "none").when(F.col("t") > F.col("_over"), "invalid").otherwise("valid")
    return told.withColumn("status", status).select(*frames.columns, "version", "since", "failures", "status")


@dataclass
class Calibration:
    """The same as a state that sees loadings and frames in order of time."""

    most: int = MOST_FAILURES
    version: str | None = None
    since: float | None = None
    failures: int = 0
    valid: bool = True

    def load(self, t: float, version: str | None) -> None:
        self.version, self.since, self.failures, self.valid = version, t, 0, True

    def frame(self, ok: bool | None) -> tuple[str | None, float | None, int, str]:
        """version, since, failures, status."""
        held = "none" if self.since is None else "valid" if self.valid else "invalid"
        if ok is not None:
            self.failures = 0 if ok else self.failures + 1
        if self.failures >= self.most:
            self.valid = False
        return self.version, self.since, self.failures, held
