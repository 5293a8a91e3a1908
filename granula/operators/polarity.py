"""Directional statistics of instances: weights, reference axes, polarity and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.prefix import running_sums
from granula.functions.storage import unsent


def size_weights(rows: DataFrame, size: str, by: list[str]) -> DataFrame:
    """``w``: the size where positive; if any row of the group has none, all weigh 1."""
    good = F.when(F.col(size) > 0, F.col(size))
    whole = W.partitionBy(*by)
    return rows.withColumn("w", F.when(F.count(good).over(whole) == F.count(F.lit(1)).over(whole), good).otherwise(F.lit(1.0)))


def reference_offset(rows: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean of unit x distance of (w, nz, ny, nx, dist); null where it cancels."""
    mean = {a: F.try_divide(F.sum(F.col("w") * F.col(f"n{a}") * F.col("dist")), F.sum("w")) for a in "zyx"}
    out = rows.groupBy(*by).agg(*[m.alias(f"o{a}") for a, m in mean.items()])
    length = F.sqrt(sum(F.col(f"o{a}") ** 2 for a in "zyx"))
    return out.withColumn("offset_um", F.when(length > 1e-12, length))


def polarity(rows: DataFrame, by: list[str]) -> DataFrame:
    """R = |sum w n| / sum w, and V = (sum w n . axis) / sum w of (w, nz, ny, nx, az, ay, ax)."""
    total = F.sum("w")
    length = F.sqrt(sum(F.sum(F.col("w") * F.col(f"n{a}")) ** 2 for a in "zyx"))
    dot = sum(F.col(f"n{a}") * F.col(f"a{a}") for a in "zyx")
    return rows.groupBy(*by).agg(F.try_divide(length, total).alias("polarity_r"), F.try_divide(F.sum(F.col("w") * dot), total).alias("polarity_v"))


def cone_angles(rows: DataFrame) -> DataFrame:
    """Angle of each direction to its axis, 0 to 180 degrees."""
    return rows.withColumn("cone_deg", scalar.cone_angle(sum(F.col(f"n{a}") * F.col(f"a{a}") for a in "zyx")))


def circular_mean(rows: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Weighted mean direction of angles in degrees; null where it cancels."""
    s, c = (F.sum(F.col("w") * f(F.radians(angle))) for f in (F.sin, F.cos))
    return rows.groupBy(*by).agg(F.when(F.sqrt(s * s + c * c) > 1e-9, F.degrees(F.atan2(s, c))).alias("circular_mean_deg"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Least value whose cumulative weight reaches q of the total; weights are summed by ranges of values."""
    weights = rows.groupBy(*by, value).agg(F.sum("w").alias("w"))
    sums = running_sums(weights, by, value, "w", name)
    return sums.where(F.col("below") + F.col("w") >= q * F.col("total")).groupBy(*by).agg(F.min(value).alias("quantile"))


def references(offsets: DataFrame) -> DataFrame:
    """(entity, n_objects, offset_um) of structures that can serve as a reference: by objects, then by mean offset, the greatest first; null offsets are not offered."""
    found = offsets.where("offset_um is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_objects"), F.avg("offset_um").alias("offset_um"))
    return found.orderBy(F.desc("n_objects"), F.desc("offset_um"), "entity")


def frame(az: Column, ay: Column, ax: Column) -> dict[str, Column]:
    """A unit direction across an axis (z, y, x): the axis of its least component made orthogonal to it."""
    axis = {"z": az, "y": ay, "x": ax}
    size = {k: F.abs(v) for k, v in axis.items()}
    least = F.when((size["z"] <= size["y"]) & (size["z"] <= size["x"]), "z").when(size["y"] <= size["x"], "y").otherwise("x")
    along = F.when(least == "z", az).when(least == "y", ay).otherwise(ax)
    raw = {k: F.when(least == k, F.lit(1.0)).otherwise(0.0) - along * v for k, v in axis.items()}
    length = F.sqrt(raw["z"] * raw["z"] + raw["y"] * raw["y"] + raw["x"] * raw["x"])
    return {f"u{k}": F.try_divide(v, length) for k, v in raw.items()}


def signed_angles(rows: DataFrame) -> DataFrame:
    """``rows`` (nz, ny, nx, az, ay, ax) with the frame's second direction and the signed angle to the axis in its plane, in degrees."""
    rows = rows.withColumns(frame(F.col("az"), F.col("ay"), F.col("ax")))
    across, along = (sum(F.col(f"n{a}") * F.col(f"{d}{a}") for a in "zyx") for d in "ua")
    return rows.withColumn("signed_deg", F.degrees(F.atan2(across, along)))


def cell_points(rows: DataFrame, reference: str) -> DataFrame:
    """(object_id, entity, cone_deg, r): the mean direction of each structure but the reference, as its angle to the axis and its length."""
    mean = rows.where(F.col("entity") != reference).groupBy("object_id", "entity").agg(*[(F.sum(F.col("w") * F.col(f"n{a}")) / F.sum("w")).alias(f"m{a}") for a in "zyx"], *[F.first(f"a{a}").alias(f"a{a}") for a in "zyx"])
    r = F.sqrt(sum(F.col(f"m{a}") ** 2 for a in "zyx"))
    dot = F.try_divide(sum(F.col(f"m{a}") * F.col(f"a{a}") for a in "zyx"), r)
    return mean.select("object_id", "entity", F.when(r > 1e-12, scalar.cone_angle(dot)).alias("cone_deg"), r.alias("r"))


def wedge_share(low_deg: Column, high_deg: Column) -> Column:
    """Share of directions without preference whose angle to an axis lies between two angles: half the difference of their cosines."""
    return (F.cos(F.radians(low_deg)) - F.cos(F.radians(high_deg))) / 2


def layout(kind: str, cone: Column, signed: Column, dist: Column, t: Column | float = 1.0) -> dict[str, Column]:
    """Plot positions, moved from straight plot axes (t = 0) to a layout (t = 1).

    half: a half circle by cone angle; circle: a full one by signed angle; cart: the plane
    itself; unit: the unit circle without the distance.
    """
    start = {"px": cone / 180.0, "py": dist}
    radians = F.radians(cone) if kind == "half" else F.radians(signed)
    reach = F.lit(1.0) if kind in ("unit",) else dist
    end = {"px": reach * F.cos(radians), "py": reach * F.sin(radians)} if kind != "cart" else {"px": dist * F.sin(F.radians(signed)), "py": dist * F.cos(F.radians(signed))}
    part = t if isinstance(t, Column) else F.lit(float(t))
    return {k: start[k] + (end[k] - start[k]) * part for k in start}


def recovered_centres(rows: DataFrame, by: list[str], position: dict[str, str]) -> DataFrame:
    """Centre of each object as the median over instances of position less direction times distance, per axis."""
    return rows.groupBy(*by).agg(*[F.median(F.col(position[a]) - F.col(f"n{a}") * F.col("dist")).alias(f"centre_{a}") for a in "zyx"])


def spread(voxels: DataFrame, centre: DataFrame, spacing: Sequence[float], keys: list[str]) -> DataFrame:
    """(keys, polar_spread_deg): standard deviation of the angles of an instance's voxels to their mean direction from the centre (object_id, cz, cy, cx) in micrometres; null under three voxels off the centre."""
    rows = voxels.join(unsent(centre), "object_id")
    off = [F.col(c) * s - F.col(f"c{c}") for c, s in zip("zyx", spacing, strict=True)]
    n = F.sqrt(sum(o * o for o in off))
    rows = rows.select(*keys, *[F.try_divide(o, n).alias(f"n{c}") for o, c in zip(off, "zyx", strict=True)]).where("nz is not null")
    mean = rows.groupBy(*keys).agg(*[F.avg(f"n{c}").alias(f"m{c}") for c in "zyx"])
    length = F.sqrt(F.col("mz") ** 2 + F.col("my") ** 2 + F.col("mx") ** 2)
    dot = sum(F.col(f"n{c}") * F.try_divide(F.col(f"m{c}"), length) for c in "zyx")
    angle = rows.join(unsent(mean), keys).withColumn("angle", scalar.cone_angle(dot))
    return angle.groupBy(*keys).agg(F.when(F.count("angle") >= 3, F.stddev_pop("angle")).alias("polar_spread_deg"))
