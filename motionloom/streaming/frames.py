"""Live counterparts on Structured Streaming: frame joins with a time limit, windows, stateful filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_frames(camera: DataFrame, skeleton: DataFrame, wait: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Camera frames with the skeleton result of the same key that comes within `wait`, or none.

    camera: key, ts and more; skeleton: key, ts and more, which become skel_*. State is bounded by the watermarks.
    """
    left = camera.withWatermark("ts", late)
    right = skeleton.select(*[F.col(c).alias(f"skel_{c}") for c in skeleton.columns]).withWatermark("skel_ts", late)
    near = F.expr(f"skel_key = key and skel_ts >= ts - interval {wait} and skel_ts <= ts + interval {wait}")
    return left.join(right, near, "leftOuter" if camera.isStreaming else "left")


def align_cameras(obs: DataFrame, cameras: int, late: str = "10 seconds", span: str = "1 hour") -> DataFrame:
    """Per frame and window: cameras that delivered it, and whether all did."""
    marked = obs.withWatermark("ts", late) if obs.isStreaming else obs
    counts = marked.groupBy(F.window("ts", span), "frame").agg(F.size(F.collect_set("camera_id")).cast("long").alias("n_cameras"))
    return counts.select(F.col("window.start").alias("start"), "frame", "n_cameras", (F.col("n_cameras") >= cameras).alias("complete"))


def tumbling(values: DataFrame, span: str, by: tuple[str, ...] = (), late: str = "10 seconds") -> DataFrame:
    """start, by, n, mean, min, max of `value` in each window: the throttled reports."""
    marked = values.withWatermark("ts", late) if values.isStreaming else values
    grouped = marked.groupBy(F.window("ts", span), *by)
    told = grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return told.select(F.col("window.start").alias("start"), *by, "n", "mean", "min", "max")


def latest_per_trigger(batch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest frame of a micro-batch (of each recording, by) and how many older ones were passed over; for foreachBatch."""
    return batch.groupBy(*by).agg(F.max("frame").alias("frame"), (F.count_distinct("frame") - 1).alias("dropped"))


def filter_stream(points: DataFrame, make_step, columns: list[str], flag: str, by: tuple[str, ...] = ("keypoint",)) -> DataFrame:
    """Runs a step function of operators.temporal per key over a stream in order of t.

    points: by (as recording, keypoint), t (seconds), ts and columns. The step object is the state; rows of one trigger are
    taken in order of t.
    """
    import pickle

    import numpy as np
    import pandas as pd

    fields = ", ".join(f"{c} double, {c}_out double" for c in columns)
    keys = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in by)

    def run(key, batches, state):
        step = pickle.loads(state.get[0]) if state.exists else make_step()
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        seen = rows[columns].to_numpy(float)
        out, marks = np.full_like(seen, np.nan), []
        for n, (t, x) in enumerate(zip(rows["t"].to_numpy(float).tolist(), seen, strict=True)):
            got = step.step(t, x)
            value, marked = got if isinstance(got, tuple) else (got, False)
            if value is not None:
                out[n] = value
            marks.append(bool(marked))
        state.update((pickle.dumps(step),))
        told = {k: [v] * len(rows) for k, v in zip(by, key, strict=True)} | {"t": rows["t"].to_numpy()}
        for n, c in enumerate(columns):
            told |= {c: seen[:, n], f"{c}_out": out[:, n]}
        yield pd.DataFrame(told | {flag: marks})

    return points.groupBy(*by).applyInPandasWithState(run, f"{keys}, t double, {fields}, {flag} boolean", "step binary", "append", "NoTimeout")


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Runs a streaming query over what is there and returns its rows."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
