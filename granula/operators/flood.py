"""Seeded flooding and cells over bricks: each task holds one brick and a layer around it.

A flood gives every voxel of a space the seed that reaches it first when the level rises: by the
highest height on the way, then by the steps since that level was met, then by the lesser
seed. A voxel's label follows from those of its neighbours and is greater than the one it
comes from, so the labels of a volume are unique, whatever the order in which bricks settle.

Each round solves the bricks whose surroundings changed, from the labels that their neighbours
have on the common faces, and passes on the labels of their own outermost voxels; the round
is written to the shared folder. Rounds end when no label on a face changes.

Defined results: voxels that no seed reaches have no row; seeds outside the space are dropped,
of several seeds on one voxel the least counts; repeated voxels count once, with their least
height; an empty space or no seed gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import spread, stored, unsent
from granula.operators import distance, graph
from granula.operators.bricks import SIDE, Brick, bricked
from granula.operators.graph import neighbour_offsets

AT = ["object_id", "z", "y", "x"]
NAMES = ["object_id", "bz", "by", "bx"]
LABEL = ["level", "steps", "seed"]


def settled(near: np.ndarray, height: np.ndarray, level: np.ndarray, steps: np.ndarray, seed: np.ndarray, fixed: np.ndarray) -> None:
    """Label the voxels of one brick in place until nothing changes; ``near`` has the neighbours of each, -1 for none, ``fixed`` those that keep their label.

    Only voxels beside a change are worked out again, each from all its neighbours, so a label that lost its source goes, too.
    """
    start = (level.copy(), steps.copy(), seed.copy())
    todo = np.flatnonzero(seed >= 0)
    while len(todo):
        beside = near[todo].ravel()
        beside = np.unique(beside[beside >= 0])
        beside = beside[~fixed[beside]]
        best = [a[beside].copy() for a in start]
        for k in range(near.shape[1]):
            n = near[beside, k]
            has = (n >= 0) & (seed[n] >= 0)
            up = height[beside] > level[n]
            found = (np.maximum(level[n], height[beside]), np.where(up, 0, steps[n] + 1), seed[n])
            less = (found[0] < best[0]) | (found[0] == best[0]) & ((found[1] < best[1]) | (found[1] == best[1]) & (found[2] < best[2]))
            take = has & ((best[2] < 0) | less)
            for a, b in zip(best, found, strict=True):
                a[take] = b[take]
        moved = (best[0] != level[beside]) | (best[1] != steps[beside]) | (best[2] != seed[beside])
        todo = beside[moved]
        level[todo], steps[todo], seed[todo] = (b[moved] for b in best)


def _solve(side: int, full: bool, faces: bool):
    """Labels of a brick's own voxels, or of those on its faces alone."""
    offsets = neighbour_offsets(3, full)

    def run(key: tuple, own: pa.Table, halo: pa.Table) -> pa.Table:
        n = len(own)
        at = np.concatenate([np.stack([t[a].to_numpy() for a in "zyx"], 1).astype(np.int64).reshape(-1, 3) for t in (own, halo)])
        if not n:
            at = at[:0]
        corner = [k.as_py() for k in key[1:]]
        if len(at):
            brick = Brick(at, corner, side)
            dense = brick.field(np.arange(len(at)), -1)
            near = np.stack([dense[brick.flat + brick.step(o)] for o in offsets], 1)
            height = np.concatenate([own["height"].to_numpy(), np.zeros(len(halo))])
            first = own["seed"].fill_null(-1).to_numpy()
            level = np.concatenate([np.where(first >= 0, height[:n], np.inf), halo["level"].to_numpy()])
            steps = np.concatenate([np.zeros(n, np.int64), halo["steps"].to_numpy()])
            seed = np.concatenate([first, halo["seed"].to_numpy()])
            fixed = seed >= 0  # seeds keep theirs, and a neighbour's labels are its own
            settled(near, height, level, steps, seed, fixed)
            keep = seed[:n] >= 0
            if faces:
                inner = at[:n] - np.array(corner) * side
                keep &= ((inner == 0) | (inner == side - 1)).any(axis=1)
            at, level, steps, seed = at[:n][keep], level[:n][keep], steps[:n][keep], seed[:n][keep]
        else:
            level, steps, seed = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        out = {"object_id": pa.array([key[0].as_py()] * len(at), own.schema.field("object_id").type)} | {c: pa.array(at[:, k], pa.int32()) for k, c in enumerate("zyx")}
        return pa.table(out | {"level": pa.array(level, pa.float64()), "steps": pa.array(steps, pa.int64()), "seed": pa.array(seed, pa.int64())})

    return run


def flooded(space: DataFrame, seeds: DataFrame, full: bool = False, side: int = SIDE, name: str = "flood") -> DataFrame:
    """(object_id, z, y, x, level, steps, seed): ``space`` (object_id, z, y, x, height) flooded from ``seeds`` (object_id, z, y, x, seed >= 0) over faces, or all 26 neighbours if ``full``."""
    kind = dict(space.dtypes)["object_id"]
    schema = f"object_id {kind}, z int, y int, x int, level double, steps long, seed long"
    cells = space.groupBy(*AT).agg(F.min(F.col("height").cast("double")).alias("height"))
    own = cells.join(unsent(seeds.where("seed >= 0").groupBy(*AT).agg(F.min(F.col("seed").cast("long")).alias("seed"))), AT, "left")
    own = stored(spread(bricked(own, side, halo=(0, 0, 0)), *NAMES), f"{name}-bricks")
    place = [F.floor(F.col(a) / side).cast("int").alias(f"b{a}") for a in "zyx"]
    elsewhere = ~((F.col("hz") == F.col("bz")) & (F.col("hy") == F.col("by")) & (F.col("hx") == F.col("bx")))

    def around(faces: DataFrame) -> DataFrame:
        """Labels on faces, dealt to the other bricks that they border on."""
        from_ = faces.withColumns({f"h{a}": p for a, p in zip("zyx", place, strict=True)})
        return bricked(from_, side).where(elsewhere).drop("hz", "hy", "hx")

    faces = space.sparkSession.createDataFrame([], schema)
    active = own.select(*NAMES).distinct()
    while True:
        halo = around(faces).join(active, NAMES, "left_semi")
        now = own.join(active, NAMES, "left_semi").groupBy(*NAMES).cogroup(halo.groupBy(*NAMES)).applyInArrow(_solve(side, full, True), schema)
        now = stored(now, f"{name}-faces")
        changed = now.join(faces, [*AT, *LABEL], "left_anti")
        kept = faces.select("*", *place).join(active, NAMES, "left_anti").select(*AT, *LABEL)
        active = stored(around(changed).select(*NAMES).distinct().join(own.select(*NAMES).distinct(), NAMES, "left_semi"), f"{name}-active")
        faces = stored(now.select(*AT, *LABEL).unionByName(kept), f"{name}-faces")
        if active.isEmpty():
            break
    return own.groupBy(*NAMES).cogroup(around(faces).groupBy(*NAMES)).applyInArrow(_solve(side, full, False), schema)


def brick_dilated(voxels: DataFrame, rounds: int = 1, keys: Sequence[str] = ("object_id", "entity"), side: int = SIDE) -> DataFrame:
    """``voxels`` (keys, z, y, x) grown ``rounds`` times by their 26 neighbours, one dense brick a task: a row for a voxel and a few at borders."""
    keys = list(keys)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low = np.array([k.as_py() for k in key[len(keys) :]]) * side - rounds
        mask = np.zeros((side + 2 * rounds,) * 3, bool)
        mask[tuple((np.stack([rows[a].to_numpy() for a in "zyx"], 1).astype(np.int64) - low).T)] = True
        for axis in range(3):  # a cube is grown axis by axis
            whole = mask.copy()
            for d in range(1, rounds + 1):
                to, of = [slice(None)] * 3, [slice(None)] * 3
                to[axis], of[axis] = slice(d, None), slice(None, -d)
                whole[tuple(to)] |= mask[tuple(of)]
                whole[tuple(of)] |= mask[tuple(to)]
            mask = whole
        at = np.argwhere(mask[(slice(rounds, rounds + side),) * 3]) + low + rounds
        out = {k: pa.array([v.as_py()] * len(at), rows.schema.field(k).type) for k, v in zip(keys, key, strict=False)}
        return pa.table(out | {c: pa.array(at[:, k], pa.int32()) for k, c in enumerate("zyx")})

    kind = dict(voxels.dtypes)
    names = ["bz", "by", "bx"]
    rows = bricked(voxels.select(*keys, "z", "y", "x"), side, halo=(rounds,) * 3)
    return spread(rows, *keys, *names).groupBy(*keys, *names).applyInArrow(run, ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "z int", "y int", "x int"]))


def cells(voxels: DataFrame, shape: Sequence[int], spacing: Sequence[float], walls: int = 3, least_um3: float = 40.0, reach_um: float | None = None, side: int = SIDE, name: str = "cells") -> DataFrame:
    """(object_id, z, y, x, label): the cells of each volume of ``shape``, 1, 2, ... by falling size of their seed.

    ``voxels`` (object_id, entity, z, y, x) hold the entities ``membrane``, ``seed`` and, if any,
    ``outside``. Membranes grown by ``walls`` voxels, and the outside, are walls. Free space that
    seeds of at least ``least_um3`` reach over faces is the inside of cells; it grows back over
    the walls, takes the layer of membrane it then touches, and is parted by a flood that
    starts at the seeds and rises from the deepest voxels. ``reach_um`` cuts off what lies
    farther from every membrane. The faces of the volume are no walls.
    """
    inside = (F.col("z") >= 0) & (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2])
    part = lambda e: voxels.where((F.col("entity") == e) & inside).select(*AT).distinct()
    membrane, outside = part("membrane"), part("outside")
    grow = lambda df, n: brick_dilated(df, n, ["object_id"], side).where(inside) if n else df
    axes = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a) for n, a in zip(shape, "zyx", strict=True)]
    grid = voxels.select("object_id").distinct().select("object_id", axes[0]).select("*", axes[1]).select("*", axes[2])
    wall = grow(membrane, walls).union(outside)
    free = grid.join(unsent(wall), AT, "left_anti")
    seed = stored(graph.voxel_components(part("seed").withColumn("entity", F.lit("seed")), full=False, name=f"{name}-seeds"), f"{name}-seeds")
    volume = float(np.prod(spacing))
    sized = seed.groupBy("object_id", "component").agg((F.count(F.lit(1)) * volume).alias("size")).where(F.col("size") >= least_um3)
    order = W.partitionBy("object_id").orderBy(F.desc("size"), "component")  # seeds of a volume are few
    ranked = stored(seed.join(sized.withColumn("seed", F.row_number().over(order)), ["object_id", "component"]).select(*AT, "seed"), f"{name}-ranked")
    parts = stored(graph.voxel_components(free.withColumn("entity", F.lit("free")), full=False, name=f"{name}-free").select(*AT, "component"), f"{name}-free")
    met = parts.join(ranked, AT, "left_semi").select("object_id", "component").distinct()
    reached = parts.join(met, ["object_id", "component"], "left_semi").select(*AT)
    body = stored(grow(reached, walls).join(unsent(outside), AT, "left_anti"), f"{name}-body")
    body = stored(body.union(membrane.join(grow(body, 1), AT, "left_semi")).distinct(), f"{name}-body")
    if reach_um is not None:
        away = distance.transform(membrane.withColumn("target", F.lit("membrane")), body, spacing)
        body = stored(body.join(away.where(F.col("distance_um") > reach_um), AT, "left_anti"), f"{name}-near")
    # depth: the distance to the nearest voxel of the volume that is none of the body; where there is none, all is one plateau
    edge = grow(body, 1).join(body, AT, "left_anti").withColumn("target", F.lit("out"))
    deep = distance.transform(edge, body, spacing).select(*AT, "distance_um")
    height = body.join(deep, AT, "left").select(*AT, (-F.coalesce("distance_um", F.lit(0.0))).alias("height"))
    return flooded(height, ranked, side=side, name=name).select(*AT, F.col("seed").cast("int").alias("label"))
