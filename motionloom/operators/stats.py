"""Statistics of segments, shapes, cameras, boards and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the human-shape and equivalence verdicts.
MAX_TEMPORAL_CV, MAX_PROPORTION_CV, MAX_SYMMETRY_DIFF, MAX_EQUIVALENCE_DIFF = 0.15, 0.15, 0.15, 0.25
MIN_HEIGHT_MM, MAX_HEIGHT_MM = 1000.0, 2200.0
MIN_VALID_FRACTION, MIN_ASSESSABLE = 0.25, 4
#: Sketches of percentiles: error of a rank as one part of so many, share of a group on either side of a wanted rank, and values of a group that needs none.
SKETCH_ACCURACY, SKETCH_MARGIN, SMALL_GROUP = 10_000, 0.002, 20_000


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def segment_lengths(points: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by, segment, pair, length for every frame (by: its keys) and segment; null where an endpoint is missing.

    segments (segment, pair, proximal, distal) is a short fixed table. Points are shuffled once by frame and pivoted in the
    same aggregate: one map of positions per frame, from which both ends of every segment are taken.
    """
    entry = F.struct("keypoint", F.struct("x", "y", "z").alias("p"))
    frames = points.where("x is not null and y is not null and z is not null").groupBy(*by).agg(
        F.map_from_entries(F.collect_list(entry)).alias("at")
    )
    empty = points.select(*by).distinct().join(frames, list(by), "left")
    each = empty.join(F.broadcast(segments))
    a, b = F.try_element_at("at", "proximal"), F.try_element_at("at", "distal")
    square = sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("y", "z")), (a["x"] - b["x"]) * (a["x"] - b["x"]))
    return each.select(*by, "segment", "pair", F.sqrt(square).alias("length"))


def segment_stats(lengths: DataFrame, by: tuple[str, ...] = ("segment", "pair")) -> DataFrame:
    """Per segment over positive finite lengths: n_frames, n_valid, mean, median, std (population), mad, min, max, cv (robust).

    Without a valid length the measures are 0 and cv is null. The median's deviation needs a second pass over the lengths.
    """
    ok = F.when((F.col("length") > 0) & ~F.isnan("length"), F.col("length"))
    rows = lengths.withColumn("_l", ok)
    first = rows.groupBy(*by).agg(
        F.count("*").alias("n_frames"), F.count("_l").alias("n_valid"), F.avg("_l").alias("mean"),
        median("_l").alias("median"), F.stddev_pop("_l").alias("std"), F.min("_l").alias("min"), F.max("_l").alias("max"),
    )
    centre = F.broadcast(first.select(*by, F.col("median").alias("_m")))  # a row per segment
    mads = rows.join(centre, list(by)).groupBy(*by).agg(median(F.abs(F.col("_l") - F.col("_m"))).alias("mad"))
    both = first.join(mads, list(by), "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("mean", "median", "std", "min", "max", "mad")})
    return both.withColumn("cv", F.when(F.col("median") > 0, 1.4826 * F.col("mad") / F.col("median")))


def assessable(stats: DataFrame, ratios: DataFrame) -> DataFrame:
    """Segments with enough valid frames, with the standing height that each implies. ratios: segment, ratio."""
    enough = (F.col("n_frames") > 0) & (F.col("n_valid") >= MIN_VALID_FRACTION * F.col("n_frames")) & (F.col("median") > 0)
    return stats.where(enough).join(F.broadcast(ratios), "segment").withColumn("implied_height", F.col("median") / F.col("ratio"))


def symmetry(usable: DataFrame) -> DataFrame:
    """pair, diff: |left - right| over their mean, of pairs with both sides."""
    sided = lambda s: F.max(F.when(F.col("segment").startswith(s), F.col("median")))
    pairs = usable.groupBy("pair").agg(sided("left_").alias("l"), sided("right_").alias("r")).where("l is not null and r is not null")
    return pairs.select("pair", (F.abs(F.col("l") - F.col("r")) / ((F.col("l") + F.col("r")) / 2)).alias("diff"))


def human_shape(usable: DataFrame) -> DataFrame:
    """One row: n_assessable, height, height_cv, violations (names, sorted), passes. With too few segments nothing else is judged."""
    overall = usable.agg(
        F.count("*").alias("n_assessable"), median("implied_height").alias("height"),
        F.stddev_pop("implied_height").alias("_s"),
        F.sort_array(F.collect_list(F.when(F.col("cv") > MAX_TEMPORAL_CV, F.concat(F.lit("rigidity:"), "segment")))).alias("_rigid"),
    )
    uneven = symmetry(usable).agg(
        F.sort_array(F.collect_list(F.when(F.col("diff") > MAX_SYMMETRY_DIFF, F.concat(F.lit("symmetry:"), "pair")))).alias("_uneven")
    )
    cv = F.when((F.col("n_assessable") >= 2) & (F.col("height") > 0), F.col("_s") / F.col("height"))
    one = overall.join(F.broadcast(uneven)).withColumn("height_cv", cv)
    few = F.col("n_assessable") < MIN_ASSESSABLE
    plain = F.array_compact(
        F.array(
            F.when(F.col("height_cv") > MAX_PROPORTION_CV, F.lit("proportion")),
            F.when(~F.col("height").between(MIN_HEIGHT_MM, MAX_HEIGHT_MM), F.lit("height")),
        )
    )
    found = F.when(few, F.array(F.lit("too few segments"))).otherwise(F.concat(plain, "_rigid", "_uneven"))
    return one.select("n_assessable", "height", "height_cv", F.array_join(found, ",").alias("violations"), (F.size(found) == 0).alias("passes"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """segment, diff, equivalent for segments assessable in both: |a - b| / b of the medians."""
    joined = a.select("segment", F.col("median").alias("a")).join(b.select("segment", F.col("median").alias("b")), "segment")
    diff = F.abs(F.col("a") - F.col("b")) / F.col("b")
    return joined.select("segment", diff.alias("diff"), (diff <= MAX_EQUIVALENCE_DIFF).alias("equivalent"))


def held_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], small: int = SMALL_GROUP) -> DataFrame:
    """by, n (rows) and the exact percentiles (name: share) of a df that may be read twice. No task holds a large group's values:
    a sketch gives a value on either side of the wanted ranks, and only the few values between these two are sorted. Groups are
    few (they are broadcast)."""
    v, near = F.col(value), [min(max(p + d, 0.0), 1.0) for p in shares.values() for d in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(v).alias("_seen"), F.percentile_approx(v, near, SKETCH_ACCURACY).alias("_near"))
    groups = groups.withColumn("_near", F.when(F.col("_seen") > small, F.col("_near")))  # of small groups all values are sorted
    if by:
        on = [F.col(f"df.{k}").eqNullSafe(F.col(f"groups.{k}")) for k in by]
        joined = df.alias("df").join(F.broadcast(groups.alias("groups")), on).select(*[f"df.{k}" for k in by], f"df.{value}", "n", "_seen", "_near")
    else:
        joined = df.select(value).crossJoin(F.broadcast(groups))
    sides = [(F.get("_near", F.lit(2 * k)), F.get("_near", F.lit(2 * k + 1))) for k in range(len(shares))]
    told = []
    for k, (lo, hi) in enumerate(sides):
        between = F.col("_near").isNull() | (v > lo) & (v < hi)
        told += [F.count_if(v < lo).alias(f"_below{k}"), F.count_if(v == lo).alias(f"_low{k}"), F.count_if(v == hi).alias(f"_high{k}"), F.sort_array(F.collect_list(F.when(between, v))).alias(f"_between{k}")]
    counted = joined.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "_seen", "_near")], *told)

    def ranked(k: int, rank):
        (lo, hi), inside = sides[k], F.col(f"_between{k}")
        at = (rank - F.col(f"_below{k}") - F.col(f"_low{k}")).cast("int")
        lost = (rank < F.col(f"_below{k}")) | (at >= F.size(inside) + F.col(f"_high{k}"))
        outside = F.when(lost, F.raise_error(F.lit("a percentile is not between its sketch's values"))).when(at < 0, lo).otherwise(hi)
        return F.when((at >= 0) & (at < F.size(inside)), F.get(inside, at)).otherwise(outside)

    out = []
    for k, (name, p) in enumerate(shares.items()):
        position = (F.col("_seen") - 1) * F.lit(p)
        first, last = ranked(k, F.floor(position)), ranked(k, F.ceil(position))
        between = (F.ceil(position) - position) * first + (position - F.floor(position)) * last
        out.append(F.when(F.col("_seen") > 0, F.when(first == last, first).otherwise(between)).alias(name))
    return counted.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *out)


def pair_percentiles(errors: DataFrame, low: float = 0.15, high: float = 0.75, over: int = 10, by: tuple[str, ...] = (), held: bool = False) -> DataFrame:
    """by, cam_a, cam_b, n, low, high of the mean error of points that both see; pairs with over `over` points. held: errors may
    be read twice and pairs are few but large (see `held_percentiles`)."""
    if held:
        return held_percentiles(errors, [*by, "cam_a", "cam_b"], "error", {"low": low, "high": high}).where(F.col("n") > over)
    return errors.groupBy(*by, "cam_a", "cam_b").agg(
        F.count("*").alias("n"), F.percentile("error", F.lit(low)).alias("low"), F.percentile("error", F.lit(high)).alias("high")
    ).where(F.col("n") > over)


def board_errors(corners: DataFrame, squares_x: int, square_mm: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Signed errors of distances between neighbours on a board of squares_x columns. corners: frame, corner_id, x, y, z."""
    right = corners.where((F.col("corner_id") % squares_x) < squares_x - 1)
    other = corners.select(*by, *[F.col(c).alias(f"{c}2") for c in ("corner_id", "x", "y", "z")])
    ends = right.withColumn("corner_id2", F.col("corner_id") + 1).unionByName(corners.withColumn("corner_id2", F.col("corner_id") + squares_x))
    pairs = ends.join(other, [*by, "corner_id2"])
    square = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in ("y", "z")), (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")))
    return pairs.select(*by, "corner_id", "corner_id2", (F.sqrt(square) - square_mm).alias("error"))


def board_health(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    inside = lambda mm: 100 * F.avg((F.abs("error") < mm).cast("double"))
    return errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("error").alias("mean"), median("error").alias("median"), F.stddev_pop("error").alias("std"),
        F.avg(F.abs("error")).alias("mean_abs"), F.max(F.abs("error")).alias("max_abs"),
        inside(1.0).alias("pct_within_1mm"), inside(5.0).alias("pct_within_5mm"),
    )


def camera_sanity(cameras: DataFrame) -> DataFrame:
    """Flags of implausible intrinsics. cameras: camera_id, fx, fy, cx, cy, width, height."""
    c = F.col
    return cameras.select(
        "camera_id", ((c("fx") > 0.5 * c("width")) & (c("fx") < 3 * c("width"))).alias("focal_ok"),
        (F.abs(c("cx") - c("width") / 2) / c("width") < 0.25).alias("center_ok"), (c("fx") / c("fy")).alias("aspect"),
    )


def stage_timing(timings: DataFrame, wrapper: str | None = None) -> DataFrame:
    """stage, n, median, mean, std, q1, q3 and pct: of the wrapper's median, or else of the sum of all medians."""
    table = timings.groupBy("stage").agg(
        F.count("*").alias("n"), median("ms").alias("median"), F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("std"),
        F.percentile("ms", F.lit(0.25)).alias("q1"), F.percentile("ms", F.lit(0.75)).alias("q3"),
    )
    whole = table.agg(F.coalesce(F.max(F.when(F.col("stage") == F.lit(wrapper), F.col("median"))), F.sum("median")).alias("_whole"))
    return table.join(F.broadcast(whole)).withColumn("pct", F.try_divide(100 * F.col("median"), F.col("_whole"))).drop("_whole")


def camera_spread(timings: DataFrame) -> DataFrame:
    """stage, spread: largest less smallest of the cameras' means; 0 for one camera."""
    means = timings.groupBy("stage", "camera_id").agg(F.avg("ms").alias("_m"))
    return means.groupBy("stage").agg((F.max("_m") - F.min("_m")).alias("spread"))


def framerate_stats(intervals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of intervals in ms: n, mean, median, min, max, std, cv, fps."""
    return intervals.groupBy(*by).agg(
        F.count("ms").alias("n"), F.avg("ms").alias("mean"), median("ms").alias("median"), F.min("ms").alias("min"),
        F.max("ms").alias("max"), F.stddev_pop("ms").alias("std"), F.try_divide(F.stddev_pop("ms"), F.avg("ms")).alias("cv"),
        F.try_divide(F.lit(1000.0), F.avg("ms")).alias("fps"),
    )


def framerate_window(intervals: DataFrame, by: tuple[str, ...], t: str, last: int = 1000) -> DataFrame:
    """framerate_stats over the last rows of each key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(t)))
    return framerate_stats(intervals.withColumn("_k", rank).where(F.col("_k") <= last), by)


def histogram(values: DataFrame, column: str, widest: float = 40.0, bins: int = 30) -> DataFrame:
    """bin_start, n, density: bins of width 1, or ceil(range / bins) where the range is over `widest`."""
    extent = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_n"))
    width = F.when(F.col("_hi") - F.col("_lo") > widest, F.ceil((F.col("_hi") - F.col("_lo")) / bins)).otherwise(1)
    binned = values.where(F.col(column).isNotNull()).join(F.broadcast(extent.withColumn("_w", width)))
    start = F.floor(F.col(column) / F.col("_w")) * F.col("_w")
    counts = binned.groupBy(start.cast("double").alias("bin_start")).agg(F.count("*").alias("n"), F.first("_n").alias("_n"))
    return counts.select("bin_start", "n", (F.col("n") / F.col("_n")).alias("density"))


def plausible_fps(rates: DataFrame, column: str, least: int = 10, low: float = 1.0, high: float = 1000.0) -> DataFrame:
    """One row fps: the median of positive rates, null with under `least` of them or outside [low, high]."""
    one = rates.where(F.col(column) > 0).agg(median(column).alias("_f"), F.count("*").alias("_n"))
    return one.select(F.when((F.col("_n") >= least) & F.col("_f").between(low, high), F.col("_f")).alias("fps"))


def recording_stats(stamps: DataFrame, by: str, t: str, order: str) -> DataFrame:
    """rows, duration_s and fps = rows / duration. Durations over 1e15 are nanoseconds, over 1e6 milliseconds, else seconds."""
    ends = stamps.groupBy(by).agg(F.count("*").alias("rows"), F.min_by(t, order).alias("_a"), F.max_by(t, order).alias("_b"))
    span = F.abs(F.col("_b") - F.col("_a"))
    ends = ends.withColumn("duration_s", span / F.when(span > 1e15, 1e9).when(span > 1e6, 1e3).otherwise(1.0))
    return ends.select(by, "rows", "duration_s", F.when(F.col("duration_s") > 0, F.col("rows") / F.col("duration_s")).alias("fps"))


def in_sync(counts: DataFrame, by: str, frames: str) -> DataFrame:
    """by, n_videos, synchronized: whether all videos have one frame count."""
    return counts.groupBy(by).agg(F.count("*").alias("n_videos"), (F.count_distinct(frames) == 1).alias("synchronized"))


def stage_completeness(files: DataFrame) -> DataFrame:
    """stage, present, total. files: stage, present (boolean)."""
    return files.groupBy("stage").agg(F.count_if("present").alias("present"), F.count("*").alias("total"))


def best_half(df: DataFrame, by: list[str], order: list, least: int = 3) -> DataFrame:
    """The better half of each key's rows, `least` at least."""
    key = Window.partitionBy(*by)
    keep = F.greatest(F.floor(F.count("*").over(key) / 2), F.lit(least))
    ranked = df.withColumns({"_k": F.row_number().over(key.orderBy(*order)), "_keep": keep})
    return ranked.where("_k <= _keep").drop("_k", "_keep")


def largest_group(df: DataFrame, by: list[str], group: str) -> DataFrame:
    """by, group, n: the most frequent value of each key, of equals the smallest."""
    counts = df.groupBy(*by, group).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("_n"), group)).alias("_b")
    return counts.groupBy(*by).agg(best).select(*by, F.col(f"_b.{group}").alias(group), (-F.col("_b._n")).alias("n"))


def detection_counts(points: DataFrame, by: list[str], total: int) -> DataFrame:
    """by, detected (rows with a position), total (the fixed number of points there are)."""
    return points.groupBy(*by).agg(F.count("x").alias("detected"), F.lit(total).cast("long").alias("total"))


def frame_range(frames: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    return frames.groupBy(*by).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count_distinct(frame).alias("n_frames"))
