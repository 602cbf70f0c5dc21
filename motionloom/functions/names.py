"""Names of keypoints, cameras and recordings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_stage(name: Column) -> Column:
    """`body.nose` to `nose`: cuts at the first dot only."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def side(name: Column) -> Column:
    """left, right or center."""
    low = F.lower(name)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right").otherwise("center")


def part(name: Column) -> Column:
    """hand, face or body."""
    low = F.lower(name)
    return F.when(low.contains("hand"), "hand").when(low.contains("face"), "face").otherwise("body")


def line_color_name(a: Column, b: Column) -> Column:
    """The endpoint that gives a connection its colour: the one that is not in the middle."""
    return F.when(side(a) == "center", b).otherwise(a)


def camera_index(name: Column) -> Column:
    """Number behind `camera` or `cam`, null without one."""
    found = F.regexp_extract(F.lower(name), r"(?:camera|cam)[._\-]?(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def with_aspect(name: Column, model: Column) -> Column:
    """Hand keypoints carry their aspect, as both hands have the same names."""
    aspect = F.substring_index(model, ".", -1)
    return F.when(aspect.isin("left_hand", "right_hand"), F.concat(aspect, F.lit("."), name)).otherwise(name)


def clean_path(path: Column, home: str) -> Column:
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)
