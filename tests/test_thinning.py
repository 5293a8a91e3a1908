"""Thinning in bricks against one block, its topology, and the centre lines of known shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import branches, thinning, volumes


def table(spark, shapes):
    rows = [(name, *map(int, p)) for name, m in shapes.items() for p in np.argwhere(m)]
    return spark.createDataFrame(rows, "label string, z int, y int, x int")


def whole(mask):
    block = np.pad(mask, 1)
    while True:
        after = thinning.turn(block, (-1, -1, -1))
        if (after == block).all():
            return {tuple(p) for p in (np.argwhere(block) - 1).tolist()}
        block = after


def shapes():
    z, y, x = np.indices((14, 26, 30))
    ring = np.abs(np.sqrt((y - 12) ** 2 + (x - 14) ** 2) - 8) + np.abs(z - 6) <= 2
    rod = (np.abs(z - 6) <= 2) & (np.abs(y - 9) <= 2) & (x >= 3) & (x <= 26)
    cross = rod | (np.abs(z - 6) <= 2) & (np.abs(x - 14) <= 2) & (y >= 2) & (y <= 22)
    noise = np.random.default_rng(2).random(z.shape) < 0.2
    ball = (z - 6) ** 2 + (y - 12) ** 2 + (x - 14) ** 2 <= 25
    return {"ring": ring, "rod": rod, "cross": cross, "noise": noise, "ball": ball, "dot": (z == 1) & (y == 1) & (x == 1), "two": ((z == 3) & (np.abs(y - 5) < 2) & (x < 9)) | ((z == 9) & (y > 20))}


def test_bricks_give_what_one_block_gives(spark):
    found = {}
    for r in thinning.thinned(table(spark, shapes()), ["label"], side=5, turns=1).collect():
        found.setdefault(r.label, set()).add((r.z, r.y, r.x))
    assert found == {name: whole(m) for name, m in shapes().items()}


def euler(mask):
    """Parts less loops and plus hollows, with 26 neighbours: cells of the cubical complex counted with sign."""
    m = np.pad(mask, 1)
    total = 0
    for kz in (0, 1):
        for ky in (0, 1):
            for kx in (0, 1):  # a cell shared by the voxels on its sides exists if one of them does
                cell = np.zeros(tuple(n - 1 for n in m.shape), bool)
                for d in np.ndindex(*(2 if k else 1 for k in (kz, ky, kx))):
                    cell |= m[tuple(slice(a, a + n - 1) for a, n in zip(d, m.shape, strict=True))]
                total += (-1) ** (3 - kz - ky - kx) * int(cell.sum())
    return total


def test_topology_is_kept():
    for name, m in shapes().items():
        line = np.zeros(m.shape, bool)
        line[tuple(np.array(sorted(whole(m))).T)] = True
        assert (line & ~m).sum() == 0 and volumes.labelled(line).max() == volumes.labelled(m).max(), name
        assert euler(line) == euler(m), name


def test_graphs_of_known_shapes(spark):
    rows = table(spark, {k: v for k, v in shapes().items() if k != "noise"})
    vertices, edges = thinning.centre_lines(rows, (1.0, 1.0, 1.0), ["label"], side=8)
    v, e = vertices.groupBy("label").count().collect(), edges.groupBy("label").count().collect()
    n, m = {r.label: r["count"] for r in v}, {r.label: r["count"] for r in e}
    assert m["ring"] == n["ring"] and m["rod"] == n["rod"] - 1 and m["cross"] == n["cross"] - 1 and (n["dot"], m.get("dot")) == (1, None) and m["two"] == n["two"] - 2
    found = {r.label: r for r in branches.metrics(edges, vertices, ["label"]).collect()}
    assert found["ring"].instance_branches == 1 and found["ring"].instance_length_um == pytest.approx(2 * np.pi * 8, rel=0.15)
    assert found["rod"].instance_branches == 1 and found["rod"].instance_length_um == pytest.approx(23, abs=5) and found["rod"].instance_tortuosity == pytest.approx(1.0, abs=0.1)
    assert found["cross"].instance_branches == 4 and found["dot"].instance_branches == 0
    degree = edges.select("label", F.explode(F.array("a", "b")).alias("v")).groupBy("label", "v").count().where("count = 1").groupBy("label").agg(F.count(F.lit(1)).alias("tips"))
    assert {r.label: r.tips for r in degree.collect()}["rod"] == 2 and {r.label: r.tips for r in degree.collect()}["cross"] == 4


def test_thinning_of_edge_rows(spark):
    dot = table(spark, {"a": np.ones((1, 1, 1), bool)})
    assert [tuple(r) for r in thinning.thinned(dot.union(dot), ["label"]).collect()] == [("a", 0, 0, 0)]
    assert thinning.thinned(dot.where("false"), ["label"]).count() == 0
    vertices, edges = thinning.centre_lines(dot, (1.0, 1.0, 1.0), ["label"])
    assert vertices.count() == 1 and edges.count() == 0
