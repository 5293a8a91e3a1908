"""Centre lines of instances that fit into one brick, worked on whole, against bricks, rounds and joins."""

import numpy as np
from pyspark.sql import functions as F
from test_thinning import shapes, table

from granula.operators import branches, thinning
from granula.sources import voxels as source

SPACING = (0.1, 0.05, 0.07)


def more_shapes():
    z, y, x = np.indices((30, 30, 30))
    deep = (z - 14) ** 2 + (y - 14) ** 2 + (x - 14) ** 2 <= 180
    forked = (np.abs(z - 6) <= 1) & ((np.abs(y - x) <= 2) | (np.abs(y + x - 20) <= 1)) & (x < 18)
    return shapes() | {"deep": deep, "forked": forked, "hollow": deep & ((z - 14) ** 2 + (y - 14) ** 2 + (x - 14) ** 2 > 60)}


def found(df, *columns):
    """The rows in order; equally near voxels give radii that differ in the last digit."""
    return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.select("label", *columns).collect())


def test_whole_instances_give_what_bricks_give(spark):
    rows = table(spark, more_shapes()).select("label", *[(F.col(a) + d).alias(a) for a, d in (("z", 63), ("y", 0), ("x", 120))])  # over the borders of bricks
    rows = rows.union(rows.where("label = 'cross'")).repartition(4, "label").sortWithinPartitions("label")
    vertices, edges = thinning.graph_of(thinning.thinned(rows, ["label"]), ["label"])
    placed, joined = found(thinning.radii(vertices, rows, SPACING, ["label"]), "v", "z", "y", "x", "radius"), found(edges, "a", "b")
    for cells in (1, 10**7):
        whole = thinning.whole_lines(rows, SPACING, ["label"], rows=1000, cells=cells)
        assert found(whole, "v", "z", "y", "x", "radius") == placed
        assert found(whole.select("label", F.col("v").alias("a"), F.explode("ends").alias("b")), "a", "b") == joined


def test_small_instances_take_no_rounds(spark, monkeypatch):
    rows = table(spark, {k: v for k, v in more_shapes().items() if k not in ("deep", "hollow")})
    even = (1.0, 1.0, 1.0)
    by_rounds = [found(df, *df.columns[1:]) for df in thinning.centre_lines(rows, even, ["label"], side=8)]

    def refused(*_, **__):
        raise AssertionError("instances of one brick went through bricks and rounds")

    for step in ("thinned", "graph_of", "radii"):
        monkeypatch.setattr(thinning, step, refused)
    assert [found(df, *df.columns[1:]) for df in thinning.centre_lines(rows, even, ["label"])] == by_rounds
    assert [df.count() for df in thinning.centre_lines(rows.where("false"), even, ["label"])] == [0, 0]


def test_graphs_without_a_junction_are_not_contracted(spark, monkeypatch):
    rows = spark.createDataFrame([(g, k, k + 1) for g in range(3) for k in range(4)] + [(1, 2, 9)], "g int, a int, b int")
    vertices = spark.createDataFrame([(g, k, 0.0, 0.0, float(k), 5.0) for g in range(3) for k in range(10)], "g int, v int, z double, y double, x double, radius double")
    seen, chains = [], branches.chains
    monkeypatch.setattr(branches, "chains", lambda edges, *a, **k: seen.extend(r.g for r in edges.select("g").distinct().collect()) or chains(edges, *a, **k))
    left = branches.pruned(rows, vertices, ["g"])
    assert set(seen) == {1} and left.where("g <> 1").count() == 8 and left.where("g = 1").count() == 3


def test_generated_voxels_are_compiled(spark):
    objects = spark.range(7).selectExpr("concat('obj', id) AS object_id", "id AS k")
    plan = source.generated(objects)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and source.generated(objects).where("entity = '' or label = 0").isEmpty()
