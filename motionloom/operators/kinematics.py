"""Mass, inertia and balance of a body from its keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAVITY = 9810.0  # mm/s^2
#: De Leva 1996, table 4: segment, mass, centre of mass, radii of gyration (sagittal, transverse, longitudinal).
DE_LEVA_FEMALE = (
    ("head", 0.0668, 0.5894, 0.330, 0.359, 0.318),
    ("trunk", 0.4257, 0.4151, 0.357, 0.339, 0.171),
    ("upper_arm", 0.0255, 0.5754, 0.278, 0.260, 0.148),
    ("forearm", 0.0138, 0.4559, 0.261, 0.257, 0.094),
    ("hand", 0.0056, 0.7474, 0.531, 0.454, 0.335),
    ("thigh", 0.1478, 0.3612, 0.369, 0.364, 0.162),
    ("shank", 0.0481, 0.4416, 0.271, 0.267, 0.093),
    ("foot", 0.0129, 0.4014, 0.299, 0.279, 0.139),
)
DE_LEVA_MALE = (
    ("head", 0.0694, 0.5976, 0.362, 0.376, 0.312),
    ("trunk", 0.4346, 0.4486, 0.372, 0.347, 0.191),
    ("upper_arm", 0.0271, 0.5772, 0.285, 0.269, 0.158),
    ("forearm", 0.0162, 0.4574, 0.276, 0.265, 0.121),
    ("hand", 0.0061, 0.7900, 0.628, 0.513, 0.401),
    ("thigh", 0.1416, 0.4095, 0.329, 0.329, 0.149),
    ("shank", 0.0433, 0.4459, 0.255, 0.249, 0.103),
    ("foot", 0.0137, 0.4415, 0.257, 0.245, 0.124),
)
#: Limbs from their far end to the near one; what no seen segment takes goes to the spine.
CHAINS = (
    ("right_foot", "right_shank", "right_thigh"),
    ("left_foot", "left_shank", "left_thigh"),
    ("right_forearm", "right_upper_arm"),
    ("left_forearm", "left_upper_arm"),
)
TIERS = ((0.90, 3), (0.70, 2), (0.50, 1))


def inertial_parameters(spark, sex: str = "mean") -> DataFrame:
    """segment, mass, com, k_sagittal, k_transverse, k_longitudinal for `female`, `male` or their `mean`."""
    if sex not in ("mean", "female", "male"):
        raise ValueError(f"sex must be mean, female or male, not {sex!r}")
    tables = {"female": [DE_LEVA_FEMALE], "male": [DE_LEVA_MALE]}.get(sex, [DE_LEVA_FEMALE, DE_LEVA_MALE])
    rows = [(r[0][0], *(sum(c) / len(c) for c in list(zip(*r, strict=True))[1:])) for r in zip(*tables, strict=True)]
    schema = "segment string, mass double, com double, k_sagittal double, k_transverse double, k_longitudinal double"
    return spark.createDataFrame(rows, schema)


def segment_com(ends: DataFrame, fractions: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by, segment, x, y, z of segments with both ends. ends: by, segment, px.., dx..; fractions: segment, com, mass."""
    joined = ends.join(F.broadcast(fractions.select("segment", "com")), "segment")
    at = [(F.col(f"p{c}") + (F.col(f"d{c}") - F.col(f"p{c}")) * F.col("com")).alias(c) for c in ("x", "y", "z")]
    return joined.select(*by, "segment", *at).where("x is not null")


def center_of_mass(coms: DataFrame, masses: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by, x, y, z, observed_mass, confidence (0 to 3) of the whole body.

    The mass of an unseen segment moves along its limb to the next seen segment nearer the trunk, else to the spine;
    that of an unseen head or spine is lost, as no other segment stands for it (the sum is not normalized). Only a
    segment's own mass counts as observed. masses: segment, mass, a short fixed table.
    """
    links = [(c, n, s) for c, chain in enumerate(CHAINS) for n, s in enumerate(chain)]
    spark = coms.sparkSession
    chains = spark.createDataFrame(links, "chain int, place int, segment string")
    listed = F.broadcast(masses.select("segment", "mass").join(chains, "segment", "left"))
    grid = coms.select(*by).distinct().join(listed)  # frames x about fifteen segments
    seen = grid.join(coms.select(*by, "segment", "x", "y", "z"), [*by, "segment"], "left")
    far_to_near = Window.partitionBy(*by, "chain").orderBy("place")
    taken = F.count("x").over(far_to_near.rowsBetween(Window.unboundedPreceding, -1))
    limb = seen.where("chain is not null").withColumn("_to", taken)
    moved = F.sum("mass").over(Window.partitionBy(*by, "chain", "_to"))
    limb = limb.withColumn("_carried", moved)
    own = F.when(F.col("x").isNotNull(), F.col("mass")).otherwise(0.0)
    sums = lambda weight: [F.sum(F.when(F.col("x").isNotNull(), F.col(c) * weight)).alias(f"_{c}") for c in ("x", "y", "z")]
    last = F.count("x").over(Window.partitionBy(*by, "chain", "_to"))
    limb = limb.withColumn("_orphan", F.when(last == 0, F.col("mass")).otherwise(0.0))
    limbs = limb.groupBy(*by).agg(*sums(F.col("_carried")), F.sum(own).alias("_own"), F.sum("_orphan").alias("_left"))
    of = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    trunk = seen.where(F.col("segment").isin("spine", "head")).groupBy(*by).agg(
        *[of(s, c).alias(f"{s}_{c}") for s in ("spine", "head") for c in ("x", "y", "z", "mass")]
    )
    both = limbs.join(trunk, list(by), "left")
    spine_mass = F.col("spine_mass") + F.col("_left")
    whole = lambda c: (
        F.coalesce(f"_{c}", F.lit(0.0)) + F.coalesce(F.col(f"spine_{c}") * spine_mass, F.lit(0.0)) + F.coalesce(F.col(f"head_{c}") * F.col("head_mass"), F.lit(0.0))
    )
    observed = F.col("_own") + F.when(F.col("spine_x").isNotNull(), F.col("spine_mass")).otherwise(0.0) + F.when(F.col("head_x").isNotNull(), F.col("head_mass")).otherwise(0.0)
    out = both.select(*by, *[whole(c).alias(c) for c in ("x", "y", "z")], observed.alias("observed_mass"))
    tier = F.lit(0)
    for least, number in reversed(TIERS):
        tier = F.when(F.col("observed_mass") >= least, number).otherwise(tier)
    return out.withColumn("confidence", tier)


def xcom(df: DataFrame, by: str, t: str) -> DataFrame:
    """Adds xcom_x, xcom_y: where the body would come to rest (Hof 2008); null at a height of 0 or less, or without a step back."""
    if not by:
        raise ValueError("name the key of a recording: without one all rows would go to one task")
    order = Window.partitionBy(by).orderBy(t)
    dt = F.col(t) - F.lag(t).over(order)
    omega = F.sqrt(F.lit(GRAVITY) / F.col("z"))
    at = lambda c: F.when((F.col("z") > 0) & (dt > 0), F.col(c) + (F.col(c) - F.lag(c).over(order)) / dt / omega)
    return df.withColumns({"xcom_x": at("x"), "xcom_y": at("y")})


def cmp_xy(ax: Column, ay: Column, az: Column) -> tuple[Column, Column]:
    """Centroidal moment pivot of the row's x, y, z; null without an upward force."""
    force = az + GRAVITY
    at = lambda c, a: F.when(force > 0, F.col(c) - a / force * F.col("z"))
    return at("x", ax), at("y", ay)


def inertia(masses: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Composite inertia about the centre cx, cy, cz of each key: ixx, iyy, izz, ixy, ixz, iyz, mass. Six sums, no collection."""
    m, dx, dy, dz = F.col("mass"), F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz")
    terms = {
        "ixx": m * (dy * dy + dz * dz), "iyy": m * (dx * dx + dz * dz), "izz": m * (dx * dx + dy * dy),
        "ixy": -m * dx * dy, "ixz": -m * dx * dz, "iyz": -m * dy * dz, "mass": m,
    }
    return masses.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in terms.items()])


def principal_moments(df: DataFrame) -> DataFrame:
    """Adds i1 <= i2 <= i3: eigenvalues of the symmetric inertia, in closed form."""
    c = F.col
    df = df.withColumns({"_q": (c("ixx") + c("iyy") + c("izz")) / 3, "_p1": c("ixy") * c("ixy") + c("ixz") * c("ixz") + c("iyz") * c("iyz")})
    spread = sum(((c(k) - c("_q")) * (c(k) - c("_q")) for k in ("iyy", "izz")), (c("ixx") - c("_q")) * (c("ixx") - c("_q")))
    df = df.withColumn("_p", F.sqrt((spread + 2 * c("_p1")) / 6))
    a, b, d = ((c(k) - c("_q")) for k in ("ixx", "iyy", "izz"))
    det = a * (b * d - c("iyz") * c("iyz")) - c("ixy") * (c("ixy") * d - c("iyz") * c("ixz")) + c("ixz") * (c("ixy") * c("iyz") - b * c("ixz"))
    r = F.when(c("_p") > 0, det / (2 * c("_p") * c("_p") * c("_p"))).otherwise(0.0)
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3)
    third = 2 * 3.141592653589793 / 3
    at = lambda turn: c("_q") + 2 * c("_p") * F.cos(c("_phi") + turn)
    return df.withColumns({"i1": at(third), "i2": at(2 * third), "i3": at(0.0)}).drop("_q", "_p", "_p1", "_phi")


def ellipsoid(df: DataFrame) -> DataFrame:
    """Adds semi-axes s1, s2, s3 of the solid ellipsoid with mass and the moments i1, i2, i3."""
    c = F.col
    axis = lambda i, j, k: F.sqrt(F.greatest(c(j) + c(k) - c(i), F.lit(0.0)) * 5 / (2 * c("mass")))
    return df.withColumns({"s1": axis("i1", "i2", "i3"), "s2": axis("i2", "i1", "i3"), "s3": axis("i3", "i1", "i2")})


def segment_seeds(ratios: DataFrame, height: float) -> DataFrame:
    """segment, length: ratio x height, for a body whose segments are not measured yet; raises without a positive height."""
    if not height > 0:
        raise ValueError(f"a height of {height} seeds nothing")
    length = F.col("ratio") * F.lit(float(height))
    return ratios.select("segment", F.when(F.col("ratio") > 0, length).otherwise(F.raise_error(F.concat(F.lit("no ratio of "), "segment"))).alias("length"))


def body_seeds(ratios: DataFrame, heights: DataFrame, by: list[str]) -> DataFrame:
    """by, segment, length: as segment_seeds, for many bodies. heights: by, height (null or not positive: the query fails)."""
    sure = F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.lit("a body without a height")))
    ratio = F.when(F.col("ratio") > 0, F.col("ratio")).otherwise(F.raise_error(F.concat(F.lit("no ratio of "), "segment")))
    return heights.join(F.broadcast(ratios.select("segment", "ratio"))).select(*by, "segment", (ratio * sure).alias("length"))


def principal_axes(df: DataFrame) -> DataFrame:
    """Adds i1 <= i2 <= i3 and the unit axes a1x to a3z of the tensor ixx to iyz, right-handed; all rows of a batch at once. Null
    where the tensor has a null. Of each axis's two directions that counts whose largest part is positive (the third follows)."""
    import numpy as np
    import pandas as pd

    tensor = ["ixx", "iyy", "izz", "ixy", "ixz", "iyz"]
    added = ["i1", "i2", "i3", *(f"a{k}{c}" for k in (1, 2, 3) for c in "xyz")]
    names = df.columns

    def solve(batches):
        for batch in batches:
            out, t = np.full((len(batch), 12), np.nan), batch[tensor].to_numpy(float)
            ok = np.isfinite(t).all(axis=1)
            m = t[ok][:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
            moments, axes = np.linalg.eigh(m)
            axes = axes.transpose(0, 2, 1)
            largest = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], axis=2)
            axes = axes * np.where(largest < 0, -1, 1)
            axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
            out[ok] = np.column_stack((moments, axes.reshape(-1, 9)))
            yield batch[names].join(pd.DataFrame(out, columns=added, index=batch.index))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + ", ".join(f"{c} double" for c in added)
    return df.mapInPandas(solve, schema)
