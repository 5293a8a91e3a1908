"""Exact Euclidean distance fields and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import spread, stored, unsent

FINE, COARSE, BINS = 4096, 128, 20
#: Cells of a slab of planes, and comparisons of lines that are made directly.
SLAB, SMALL = 1 << 17, 200_000


def lower_envelope(cost: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min over k of cost[k] + (to - at[k]) ** 2 for each column of ``cost`` and each of ``to``; both ascend.

    Short lines are compared directly; longer ones by the envelope of parabolas, all columns
    at once, linear in the length of a line.
    """
    n, m = cost.shape
    if n * len(to) * m <= SMALL:
        return (cost[None] + ((to[:, None] - at[None]) ** 2)[:, :, None]).min(axis=1)
    columns = np.arange(m)
    held = np.zeros((n, m), np.int64)  # sources on each column's envelope
    start = np.full((n + 1, m), np.inf)  # where each becomes the least
    top = np.full(m, -1)
    for k in range(n):
        live = columns[np.isfinite(cost[k])]
        cut = np.full(m, -np.inf)
        todo = live[top[live] >= 0]
        while len(todo):
            last = held[top[todo], todo]
            meet = (cost[k, todo] - cost[last, todo] + at[k] ** 2 - at[last] ** 2) / (2 * (at[k] - at[last]))
            drop = meet <= start[top[todo], todo]
            cut[todo] = meet
            gone = todo[drop]
            top[gone] -= 1
            cut[gone] = -np.inf
            todo = gone[top[gone] >= 0]
        top[live] += 1
        held[top[live], live] = k
        start[top[live], live] = cut[live]
    out = np.full((len(to), m), np.inf)
    some = columns[top >= 0]
    here = np.zeros(m, np.int64)
    for k, t in enumerate(to):
        move = some
        while len(move := move[(here[move] < top[move])]) and len(move := move[start[here[move] + 1, move] <= t]):
            here[move] += 1
        source = held[here[some], some]
        out[k, some] = cost[source, some] + (t - at[source]) ** 2
    return out


def transform(targets: DataFrame, points: DataFrame, spacing: Sequence[float], name: str = "distance", carry: Sequence[str] = ()) -> DataFrame:
    """Least distance from each point (object_id, z, y, x) to the voxels of each target (object_id, target, z, y, x).

    Separable and linear in the voxels of the points' box: slabs of planes give the distances
    along x and y, slabs across them the last step along z, each by lower envelopes. A slab
    holds SLAB cells, one plane at least. Lines travel as one row with packed distances.
    Points without any target voxel have no row. Columns named in ``carry`` travel with the
    points to the lines of the field, so measures by instance need no join of voxels with it;
    a point may come with several of them.
    """
    sz, sy, sx = spacing
    ends = [f(c).cast("int").alias(f"{c}{n}") for c in "zyx" for n, f in ((0, F.min), (1, F.max))]
    box = points.groupBy("object_id").agg(*ends)
    kind = dict(targets.dtypes)
    keys = f"object_id {kind['object_id']}, target {kind['target']}"
    thick = lambda a, b: F.greatest(F.lit(1), F.floor(F.lit(SLAB) / ((F.col(f"{a}1") - F.col(f"{a}0") + 1) * (F.col(f"{b}1") - F.col(f"{b}0") + 1))))
    rows = targets.select("object_id", "target", *[F.col(c).cast("int").alias(c) for c in "zyx"]).distinct().join(unsent(box), "object_id")
    rows = rows.withColumn("slab", F.floor(F.col("z") / thick("y", "x")))
    line = ["z0", "z1", "y0", "y1", "x0", "x1"]

    def flat(key: tuple, rows: pa.Table) -> pa.Table:
        z, y, x = (rows[c].to_numpy().astype(np.int64) for c in "zyx")
        z0, z1, y0, y1, x0, x1 = (rows[c][0].as_py() for c in line)
        planes, at = np.unique(z, return_inverse=True)
        ys, there = np.unique(y, return_inverse=True)
        xs, col = np.unique(x, return_inverse=True)
        cost = np.full((len(xs), len(planes), len(ys)), np.inf)
        cost[col, at, there] = 0.0
        near = lower_envelope(cost.reshape(len(xs), -1), xs * sx, np.arange(x0, x1 + 1) * sx)
        near = near.reshape(-1, len(planes), len(ys)).transpose(2, 1, 0).reshape(len(ys), -1)
        full = lower_envelope(near, ys * sy, np.arange(y0, y1 + 1) * sy).reshape(y1 - y0 + 1, len(planes), -1)
        lines = [full[j, i].tobytes() for j in range(y1 - y0 + 1) for i in range(len(planes))]
        m = len(lines)
        out = {k: pa.array([v] * m, rows.schema.field(k).type) for k, v in zip(("object_id", "target"), key, strict=False)}
        out |= {"y": pa.array(np.repeat(np.arange(y0, y1 + 1), len(planes)), pa.int32()), "z": pa.array(np.tile(planes, y1 - y0 + 1), pa.int32())}
        return pa.table(out | {c: pa.array([rows[c][0].as_py()] * m, pa.int32()) for c in line} | {"d": pa.array(lines, pa.binary())})

    def deep(key: tuple, rows: pa.Table) -> pa.Table:
        z, y = (rows[c].to_numpy().astype(np.int64) for c in "zy")
        z0, z1, x0, x1 = (rows[c][0].as_py() for c in ("z0", "z1", "x0", "x1"))
        zs, at = np.unique(z, return_inverse=True)
        ys, there = np.unique(y, return_inverse=True)
        cost = np.full((len(zs), len(ys), x1 - x0 + 1), np.inf)
        cost[at, there] = np.frombuffer(b"".join(rows["d"].to_pylist()), np.float64).reshape(len(z), -1)
        found = np.sqrt(lower_envelope(cost.reshape(len(zs), -1), zs * sz, np.arange(z0, z1 + 1) * sz)).reshape(z1 - z0 + 1, len(ys), -1)
        m = found.shape[0] * len(ys)
        out = {k: pa.array([v] * m, rows.schema.field(k).type) for k, v in zip(("object_id", "target"), key, strict=False)}
        out |= {"z": pa.array(np.repeat(np.arange(z0, z1 + 1), len(ys)), pa.int32()), "y": pa.array(np.tile(ys, z1 - z0 + 1), pa.int32()), "x0": pa.array([x0] * m, pa.int32())}
        values = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * (x1 - x0 + 1), found.ravel())
        return pa.table(out | {"d": values})

    columns = ", ".join(f"{c} int" for c in line)
    lines = spread(rows, "object_id", "target", "slab").groupBy("object_id", "target", "slab").applyInArrow(flat, f"{keys}, y int, z int, {columns}, d binary")
    lines = lines.withColumn("across", F.floor(F.col("y") / thick("z", "x")))
    field = spread(lines, "object_id", "target", "across").groupBy("object_id", "target", "across").applyInArrow(deep, f"{keys}, z int, y int, x0 int, d array<double>")
    # points meet the field by line: one row for each line of an object, as wide as its box
    wanted = points.select("object_id", F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y"), "x", *carry).groupBy("object_id", "z", "y").agg(F.collect_set(F.struct("x", *carry)).alias("xs"))
    found = F.transform("xs", lambda p: F.struct(p.alias("p"), F.get("d", (p["x"] - F.col("x0")).cast("int")).alias("d")))
    met = wanted.join(unsent(field), ["object_id", "z", "y"]).select("object_id", "target", "z", "y", F.explode(found).alias("f"))
    return stored(met.select("object_id", "target", "z", "y", "f.p.x", *[F.col(f"f.p.{c}") for c in carry], F.col("f.d").alias("distance_um")), name)


def complement(voxels: DataFrame, mask: str) -> DataFrame:
    """Voxels of the mask's bounding box that are not in it, as target ``mask``: what depth is measured to."""
    inside = voxels.where(F.col("entity") == mask).select("object_id", "z", "y", "x")
    box = inside.groupBy("object_id").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max))])
    for c in "zyx":
        box = box.withColumn(c, F.explode(F.sequence(f"min_{c}", f"max_{c}")))
    return box.select("object_id", "z", "y", "x").join(unsent(inside), ["object_id", "z", "y", "x"], "left_anti").withColumn("target", F.lit(mask))


def nearest(carried: DataFrame) -> DataFrame:
    """Least and mean distance of each instance to each other entity, from a field that carries entity and label."""
    met = carried.where(F.col("entity") != F.col("target"))
    return met.groupBy("object_id", "entity", "label", "target").agg(F.min("distance_um").alias("distance_um"), F.avg("distance_um").alias("distance_mean_um"))


def instance_distances(voxels: DataFrame, field: DataFrame) -> DataFrame:
    """The same from voxels and a field of all points."""
    return nearest(voxels.join(unsent(field), ["object_id", "z", "y", "x"]))


def binned(value, low, high, bins: int):
    """Bin numbers; the top edge lies in the last bin; an empty range is one wide."""
    width = F.when(high <= low, F.lit(1.0)).otherwise(high - low)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value - low) / width * bins))).cast("int")


def histograms(rows: DataFrame, keys: list[str], span: list[str], value: str = "distance_um", bins: int = BINS) -> DataFrame:
    """Counts by bin as JSON text for each key; the range is that of the ``span`` group."""
    ends = rows.groupBy(*span).agg(F.min(value).alias("hist_min"), F.max(value).alias("hist_max"))
    counted = rows.join(unsent(ends), span).groupBy(*keys, "hist_min", "hist_max", binned(F.col(value), F.col("hist_min"), F.col("hist_max"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy(*keys, "hist_min", "hist_max").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)))
    return found.select(*keys, "hist_min", "hist_max", F.to_json(dense).alias("hist_counts"))


def baseline(field: DataFrame, region: DataFrame, excluded: DataFrame) -> DataFrame:
    """Mean, interpolated median and voxels of the distance to each target over a region, without excluded voxels and the target itself."""
    at = ["object_id", "z", "y", "x"]
    return baseline_of(field.join(unsent(region.select(*at).distinct()), at, "left_semi").join(unsent(excluded.select(*at).distinct()), at, "left_anti"))


def baseline_of(field: DataFrame) -> DataFrame:
    """The same for a field of the region's voxels alone."""
    rows = field.where("distance_um > 0")
    keys = ["object_id", "target"]
    ends = rows.groupBy(*keys).agg(F.min("distance_um").alias("lo"), F.max("distance_um").alias("hi"), F.count(F.lit(1)).alias("baseline_voxels"), F.avg("distance_um").alias("baseline_mean_um"))
    wide = F.when(F.col("hi") <= F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    bins = rows.join(unsent(ends), keys).groupBy(*keys, "lo", wide.alias("wide"), "baseline_voxels", "baseline_mean_um", binned(F.col("distance_um"), F.col("lo"), F.col("hi"), FINE).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # 4096 rows at most
    cum = bins.withColumn("cum", F.sum("n").over(upto)).where(F.col("cum") * 2 >= F.col("baseline_voxels"))
    first = cum.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("bin"))).where("k = 1")
    inner = (F.col("baseline_voxels") / 2 - (F.col("cum") - F.col("n"))) / F.col("n")
    return first.select(*keys, "baseline_voxels", "baseline_mean_um", (F.col("lo") + (F.col("bin") + inner) * F.col("wide") / FINE).alias("baseline_median_um"))


def baseline_histograms(field: DataFrame, region: DataFrame, excluded: DataFrame) -> DataFrame:
    """(object_id, target, baseline_hist_min_um, baseline_hist_max_um, baseline_hist_counts): COARSE stored bins of the baseline, folded from the FINE ones."""
    at = ["object_id", "z", "y", "x"]
    return baseline_histograms_of(field.join(unsent(region.select(*at).distinct()), at, "left_semi").join(unsent(excluded.select(*at).distinct()), at, "left_anti"))


def baseline_histograms_of(field: DataFrame) -> DataFrame:
    """The same for a field of the region's voxels alone."""
    rows = field.where("distance_um > 0")
    keys = ["object_id", "target"]
    ends = rows.groupBy(*keys).agg(F.min("distance_um").alias("baseline_hist_min_um"), F.max("distance_um").alias("baseline_hist_max_um"))
    low, high = F.col("baseline_hist_min_um"), F.col("baseline_hist_max_um")
    coarse = F.floor(binned(F.col("distance_um"), low, high, FINE) / (FINE // COARSE)).cast("int")
    counted = rows.join(unsent(ends), keys).groupBy(*keys, low, high, coarse.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy(*keys, "baseline_hist_min_um", "baseline_hist_max_um").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # COARSE entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)))
    return found.select(*keys, "baseline_hist_min_um", "baseline_hist_max_um", F.to_json(dense).alias("baseline_hist_counts"))


def tip_distances(tips: DataFrame, field: DataFrame, shape_box: DataFrame) -> DataFrame:
    """(object_id, entity, label, target, distance_end_min_um, distance_end_max_um) of skeleton tips (object_id, entity, label, z, y, x in voxels): rounded, clipped to the box of the object and counted once."""
    return tip_distances_of(tip_voxels(tips, shape_box).join(unsent(field), ["object_id", "z", "y", "x"]))


def tip_voxels(tips: DataFrame, shape_box: DataFrame) -> DataFrame:
    """The voxels of tips: rounded, clipped to the box of the object and counted once."""
    rows = tips.join(unsent(shape_box), "object_id")
    for a in "zyx":
        rows = rows.withColumn(a, F.greatest(F.col(f"{a}0"), F.least(F.col(f"{a}1"), F.rint(a))).cast("int"))
    return rows.select("object_id", "entity", "label", "z", "y", "x").distinct()


def tip_distances_of(carried: DataFrame) -> DataFrame:
    """The same from a field of the tips' voxels alone, which carries entity and label."""
    met = carried.where(F.col("entity") != F.col("target"))
    return met.groupBy("object_id", "entity", "label", "target").agg(F.min("distance_um").alias("distance_end_min_um"), F.max("distance_um").alias("distance_end_max_um"))
