"""Floods and cells over several bricks against a walk of the whole volume by a queue."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import flood, volumes
from granula.operators.graph import neighbour_offsets


def plain_flood(height, seeds, mask, full=False):
    """(level, steps, seed) of each voxel, taken in rising order from one queue."""
    out, todo = {}, [(height[p], 0, int(seeds[p]), p) for p in map(tuple, np.argwhere((seeds >= 0) & mask))]
    start = {p: (level, steps, seed) for level, steps, seed, p in todo}
    heapq.heapify(todo)
    while todo:
        level, steps, seed, p = heapq.heappop(todo)
        if p in out or start.get(p, (level, steps, seed)) != (level, steps, seed):
            continue
        out[p] = level, steps, seed
        for o in neighbour_offsets(3, full):
            q = tuple(a + d for a, d in zip(p, o, strict=True))
            if all(0 <= a < n for a, n in zip(q, mask.shape, strict=True)) and mask[q] and q not in out:
                heapq.heappush(todo, (height[q], 0, seed, q) if height[q] > level else (level, steps + 1, seed, q))
    return out


def rows_of(spark, name, mask, **values):
    at = np.argwhere(mask)
    return spark.createDataFrame([(name, *map(int, p), *(v[tuple(p)].item() for v in values.values())) for p in at], "object_id string, z int, y int, x int" + "".join(f", {k} {'double' if v.dtype.kind == 'f' else 'long'}" for k, v in values.items()))


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("kind", ["levels", "plateau", "maze"])
def test_floods_of_several_bricks(spark, kind, full):
    want, space, start = {}, None, None
    for k in range(4):
        rng = np.random.default_rng(k)
        shape = (9, 11, 13)
        mask = rng.random(shape) < (0.45 if kind == "maze" else 0.9)
        height = {"levels": rng.integers(0, 6, shape).astype(float), "plateau": np.zeros(shape), "maze": rng.random(shape)}[kind]
        seeds = np.where(rng.random(shape) < 0.01, rng.integers(0, 4, shape), -1)
        want |= {(f"o{k}", *p): v for p, v in plain_flood(height, seeds, mask, full).items()}
        more = rows_of(spark, f"o{k}", mask, height=height), rows_of(spark, f"o{k}", seeds >= 0, seed=seeds)
        space, start = more if space is None else (space.union(more[0]), start.union(more[1]))
    found = flood.flooded(space, start, full, side=4).collect()
    assert {(r.object_id, r.z, r.y, r.x): (r.level, r.steps, r.seed) for r in found} == want and len(found) == len(want)


def test_floods_of_edge_rows(spark):
    line = np.ones((1, 1, 10), bool)
    space = rows_of(spark, "o", line, height=np.zeros(line.shape))
    seeds = spark.createDataFrame([("o", 0, 0, 0, 5), ("o", 0, 0, 0, 3), ("o", 0, 0, 9, 4), ("o", 7, 7, 7, 1), ("p", 0, 0, 0, 1), ("o", 0, 0, 5, -1)], "object_id string, z int, y int, x int, seed long")
    found = sorted((r.x, r.seed) for r in flood.flooded(space.union(space.withColumn("height", F.lit(9.0))), seeds, side=3).collect())
    assert found == [(x, 3 if x < 5 else 4) for x in range(10)]
    assert flood.flooded(space, seeds.where("false"), side=3).count() == 0 and flood.flooded(space.where("false"), seeds, side=3).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_dilation_in_bricks(spark, rounds):
    mask = np.pad(np.random.default_rng(1).random((7, 8, 9)) < 0.02, rounds)
    rows = rows_of(spark, "o", mask).withColumn("entity", F.lit("e"))
    found = {(r.z, r.y, r.x) for r in flood.brick_dilated(rows, rounds, side=4).collect()}
    assert found == set(map(tuple, np.argwhere(volumes.grown(mask, rounds)).tolist()))


def plain_cells(membrane, outside, seed, spacing, walls, least):
    """The same steps on whole arrays."""
    parts = volumes.labelled(seed, full=False)
    sizes = np.bincount(parts.ravel())
    order = sorted((k for k in range(1, len(sizes)) if sizes[k] * np.prod(spacing) >= least), key=lambda k: (-sizes[k], k))
    free = volumes.labelled(~(volumes.grown(membrane, walls) | outside), full=False)
    seeded = np.isin(parts, order)
    inside = np.isin(free, np.unique(free[seeded & (free > 0)])) & (free > 0)
    body = volumes.grown(inside, walls) & ~outside
    body |= membrane & volumes.grown(body)
    ranked = np.full(seed.shape, -1)
    for k, part in enumerate(order, 1):
        ranked[(parts == part) & body] = k
    depth = np.sqrt(volumes.squared_distance(body, spacing))
    return plain_flood(np.where(np.isfinite(depth), -depth.round(9), 0.0), ranked, body)


def test_cells_of_a_volume_of_several_bricks(spark):
    shape, spacing = (9, 14, 22), (1.0, 0.5, 0.5)
    z, y, x = np.indices(shape)
    shell = lambda c, r: np.abs(np.sqrt((z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2) - r) < 0.6
    membrane = shell((4, 6, 6), 5) | (shell((4, 7, 15), 5) & (x > 11))
    membrane &= ~((np.abs(y - 6) < 2) & (np.abs(x - 11) < 2))  # the two cells touch where no membrane is
    seed = ((z - 4) ** 2 + (y - 6) ** 2 + (x - 5) ** 2 <= 3) | ((z - 4) ** 2 + (y - 7) ** 2 + (x - 16) ** 2 <= 5)
    seed[8, 0, 0] = True  # too small to be a cell
    outside = (y > 12) | (x > 20)
    rows = None
    for name, m in (("membrane", membrane), ("seed", seed), ("outside", outside)):
        more = rows_of(spark, "o", m).withColumn("entity", F.lit(name))
        rows = more if rows is None else rows.union(more)
    found = {(r.z, r.y, r.x): r.label for r in flood.cells(rows, shape, spacing, walls=1, least_um3=1.0, side=6).collect()}
    want = {p: s for p, (_, _, s) in plain_cells(membrane, outside, seed, spacing, 1, 1.0).items()}
    assert found == want and set(found.values()) == {1, 2}
    near = {(r.z, r.y, r.x) for r in flood.cells(rows, shape, spacing, walls=1, least_um3=1.0, reach_um=1.0, side=6).collect()}
    away = volumes.squared_distance(~membrane, spacing)
    assert near and all(away[p] <= 1.0 for p in near) and near <= set(found)
    assert flood.cells(rows, shape, spacing, walls=1, least_um3=1e6, side=6).count() == 0
