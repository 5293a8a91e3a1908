"""Sizes, centres, boundaries and shapes of labelled voxels, as aggregations.

All take voxels (object_id, entity, z, y, x, label) with label 0 absent, and a spacing in
micrometres; one hash aggregate each, combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.storage import unsent
from granula.operators import bricks
from granula.operators.graph import neighbour_offsets

INSTANCE = ["object_id", "entity", "label"]
#: Direction weights of the isotropic estimator (axes, face diagonals, body diagonals), and its flat form.
CROFTON_3D = {1: 0.0914, 2: 0.0741, 3: 0.0702}
CROFTON_2D = {1: 0.25, 2: 0.25}


def extent(spacing: Sequence[float]) -> float:
    return math.prod(spacing)


def instance_sizes(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    return voxels.groupBy(*INSTANCE).agg((F.count(F.lit(1)) * extent(spacing)).alias("volume_um3"))


def centroids(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    mean = lambda c, s: (F.avg(c) * s).alias(f"{c}_um")
    return voxels.groupBy(*INSTANCE).agg(*[mean(c, s) for c, s in zip("zyx", spacing, strict=True)])


def entity_rows(voxels: DataFrame, spacing: Sequence[float], masks: Sequence[str]) -> DataFrame:
    """Total size and instance count of each entity; the count is null for masks."""
    n = F.when(~F.col("entity").isin(*masks), F.count_distinct("label"))
    return voxels.groupBy("object_id", "entity").agg((F.count(F.lit(1)) * extent(spacing)).alias("total_volume_um3"), n.alias("instance_count"))


def object_extent(voxels: DataFrame, mask: str, spacing: Sequence[float]) -> DataFrame:
    return voxels.where(F.col("entity") == mask).groupBy("object_id").agg((F.count(F.lit(1)) * extent(spacing)).alias("object_volume_um3"))


def segmented_centre(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Centroid of the union of all entities: a voxel in two of them counts once."""
    once = voxels.select("object_id", "z", "y", "x").distinct()
    return once.groupBy("object_id").agg(*[(F.avg(c) * s).alias(f"object_center_{c}_um") for c, s in zip("zyx", spacing, strict=True)])


def boundary(voxels: DataFrame, spacing: Sequence[float], weights: dict[int, float] | None = None) -> DataFrame:
    """Surface area (three spacings) or perimeter (two) by line intercepts.

    Each voxel looks along all directions; a neighbour that is not of its instance is one
    intercept. The volume's own faces count as boundary. Bricks with a halo count them, so
    the cost is linear in the voxels and only counts by direction are shuffled after that.
    """
    return _bounded(voxels, spacing, weights).drop("__n")


def _bounded(voxels: DataFrame, spacing: Sequence[float], weights: dict[int, float] | None = None) -> DataFrame:
    """boundary() with the number of voxels, ``__n``."""
    axes = "zyx"[3 - len(spacing) :]
    flat = len(spacing) == 2
    weights = weights or (CROFTON_2D if flat else CROFTON_3D)
    scale = (math.pi / 2 if flat else 2.0) * extent(spacing)
    offsets = neighbour_offsets(len(spacing))
    counts = bricks.intercepts(voxels, offsets, ["object_id", "entity"], axes)
    share = [weights[sum(map(abs, o))] * scale / math.sqrt(sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True))) for o in offsets]
    total = sum(F.col(f"c{k}") * F.lit(w) for k, w in enumerate(share))
    return counts.select(*INSTANCE, total.alias("perimeter_um" if flat else "surface_area_um2"), F.col("n").alias("__n"))


def _moments(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    axes = "zyx"[3 - len(spacing) :]
    pairs = [(a, b) for k, a in enumerate(axes) for b in axes[k:]]
    size = dict(zip(axes, spacing, strict=True))
    return voxels.groupBy(*INSTANCE).agg(*[(F.covar_pop(a, b) * (size[a] * size[b])).alias(a + b) for a, b in pairs])


def aspect_2d(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Longest over shortest principal axis of planar instances; 0 for a collapsed axis."""
    half, root = (F.col("yy") + F.col("xx")) / 2, F.sqrt(((F.col("yy") - F.col("xx")) / 2) ** 2 + F.col("yx") ** 2)
    small = half - root
    value = F.when(small > 1e-12, F.sqrt(F.try_divide(half + root, small))).otherwise(F.lit(0.0))
    return _moments(voxels, spacing).select(*INSTANCE, value.alias("aspect_ratio_major_minor"))


def aspect_3d(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """The same in space: eigenvalues of the 3 x 3 moments in closed form (trigonometric)."""
    c = F.col
    q = (c("zz") + c("yy") + c("xx")) / 3
    off = c("zy") ** 2 + c("zx") ** 2 + c("yx") ** 2
    p = F.sqrt(((c("zz") - q) ** 2 + (c("yy") - q) ** 2 + (c("xx") - q) ** 2 + 2 * off) / 6)
    a, b, d = c("zz") - q, c("yy") - q, c("xx") - q
    det = a * (b * d - c("yx") ** 2) - c("zy") * (c("zy") * d - c("yx") * c("zx")) + c("zx") * (c("zy") * c("yx") - b * c("zx"))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    big, small = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    value = F.when(small > 1e-12, F.sqrt(F.try_divide(big, small))).otherwise(F.lit(0.0))
    return _moments(voxels, spacing).select(*INSTANCE, value.alias("aspect_ratio_major_minor"))


def equivalent_ellipsoids(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """(object_id, entity, label, z_um, y_um, x_um, diameters ascending, axes by row in x, y, z order) of the ellipsoid with the moments of each instance.

    The moments of a solid ellipsoid are a fifth of its squared radii. A collapsed axis has
    diameter 0; the eigenvectors come from numpy in Arrow batches, one row an instance.
    """
    import numpy as np
    import pyarrow as pa

    rows = _moments(voxels, spacing).join(unsent(centroids(voxels, spacing)), INSTANCE)

    def run(batches):
        for batch in batches:
            m = {c: batch.column(c).to_numpy() for c in ("zz", "zy", "zx", "yy", "yx", "xx")}
            whole = np.stack([np.stack([m["xx"], m["yx"], m["zx"]], -1), np.stack([m["yx"], m["yy"], m["zy"]], -1), np.stack([m["zx"], m["zy"], m["zz"]], -1)], 1)
            value, vector = np.linalg.eigh(whole)
            axes = np.swapaxes(vector, 1, 2)
            big = np.take_along_axis(axes, np.abs(axes).argmax(-1)[..., None], -1)
            axes = axes * np.where(big < 0, -1, 1)  # the greatest part of each axis is positive
            size = 2 * np.sqrt(5 * np.where(value > 1e-12, value, 0.0))
            lists = [pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * n, v.ravel()) for n, v in ((3, size), (9, axes))]
            keep = [batch.column(c) for c in (*INSTANCE, "z_um", "y_um", "x_um")]
            yield pa.RecordBatch.from_arrays([*keep, *lists], [*INSTANCE, "z_um", "y_um", "x_um", "diameters", "axes"])

    kinds = dict(voxels.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in INSTANCE), "z_um double, y_um double, x_um double, diameters array<double>, axes array<double>"]))


def region_metrics(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Whole masks as one region each: size, boundary, roundness and aspect ratio."""
    return shapes(voxels.withColumn("label", F.lit(1)), spacing).drop("label")


def shapes(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Size, surface, roundness and aspect of spatial instances."""
    rows = roundness(voxels, spacing).join(unsent(aspect_3d(voxels, spacing)), INSTANCE)
    return rows.select(*INSTANCE, "volume_um3", "surface_area_um2", "aspect_ratio_major_minor", "sphericity")


def roundness(voxels: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Size, surface and roundness of spatial instances, from one pass over the voxels."""
    sized = _bounded(voxels, spacing).withColumn("volume_um3", F.col("__n") * extent(spacing))
    return sized.select(*INSTANCE, "volume_um3", "surface_area_um2", scalar.roundness(F.col("volume_um3"), F.col("surface_area_um2")).alias("sphericity"))


def bounding_boxes(voxels: DataFrame) -> DataFrame:
    """Corners and fill ratio."""
    ends = [f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max))]
    box = voxels.groupBy(*INSTANCE).agg(*ends, F.count(F.lit(1)).alias("n"))
    volume = (F.col("max_z") - F.col("min_z") + 1) * (F.col("max_y") - F.col("min_y") + 1) * (F.col("max_x") - F.col("min_x") + 1)
    return box.withColumn("fill_ratio", F.col("n") / volume)


def clipped(voxels: DataFrame, mask: str) -> DataFrame:
    """Voxels inside the object mask."""
    inside = voxels.where(F.col("entity") == mask).select("object_id", "z", "y", "x")
    return voxels.join(unsent(inside), ["object_id", "z", "y", "x"], "left_semi")


def cropped(voxels: DataFrame, mask: str) -> DataFrame:
    """Voxels within the mask's bounding box, moved to its corner; objects without a mask stay as they are."""
    box = voxels.where(F.col("entity") == mask).groupBy("object_id").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max))])
    rows = voxels.join(unsent(box), "object_id", "left")
    inside = [F.col("min_z").isNull() | F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}")) for c in "zyx"]
    rows = rows.where(inside[0] & inside[1] & inside[2])
    return rows.select("object_id", "entity", *[(F.col(c) - F.coalesce(f"min_{c}", F.lit(0))).alias(c) for c in "zyx"], "label")


def split_labels(voxels: DataFrame, names: dict[int, str], entity: str) -> DataFrame:
    """One mask entity for each named id of a label volume; other ids go."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    named = F.create_map(*pairs)[F.col("label")]
    return voxels.where((F.col("entity") == entity) & named.isNotNull()).select("object_id", named.alias("entity"), "z", "y", "x", F.lit(1).alias("label"))


def auto_kind(voxels: DataFrame, mask: str) -> DataFrame:
    """label where an entity has more than one id, else mask; the object mask always is one."""
    kind = F.when((F.col("entity") == mask) | (F.count_distinct("label") <= 1), "mask").otherwise("label")
    return voxels.groupBy("object_id", "entity").agg(kind.alias("entity_kind"))


def channel_order(kinds: DataFrame, mask: str) -> DataFrame:
    """Channel numbers: the object mask first, then by kind and name."""
    from pyspark.sql import Window as W

    order = W.partitionBy("object_id").orderBy(F.col("entity") != mask, F.concat_ws(":", "entity_kind", "entity"))
    return kinds.withColumn("channel", (F.row_number().over(order) - 1).cast("long"))


def total(column: str) -> Column:
    """Sum that skips nulls and is null if all are."""
    return F.sum(column)


def edge_touch(voxels: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Which axes an entity touches the ends of; ``shape`` is that of the volume."""
    touches = [((F.min(c) == 0) | (F.max(c) == n - 1)).alias(f"touches_{c}") for c, n in zip("zyx", shape, strict=True)]
    return voxels.groupBy("object_id", "entity").agg(*touches)
