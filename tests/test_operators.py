import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.operators import contacts, distance, graph, morphology, stats


def ball(spark, r, spacing=(1.0, 1.0, 1.0)):
    n = r + 1
    rows = [("a", "e", z, y, x, 1) for z in range(-n, n + 1) for y in range(-n, n + 1) for x in range(-n, n + 1) if z * z + y * y + x * x <= r * r]
    return spark.createDataFrame(rows, "object_id string, entity string, z int, y int, x int, label int")


def test_sphere_surface_and_roundness(spark):
    row = morphology.shapes(ball(spark, 8), (1.0, 1.0, 1.0)).first()
    assert row["surface_area_um2"] == pytest.approx(4 * math.pi * 8**2, rel=0.05)
    assert row["sphericity"] == pytest.approx(1.0, abs=0.05)
    assert row["aspect_ratio_major_minor"] == pytest.approx(1.0, abs=1e-6)


def test_transform_matches_brute_force(spark):
    pts = [(z, y, x) for z in range(3) for y in range(5) for x in range(4)]
    tgt = [(0, 1, 2), (2, 4, 0)]
    s = (0.3, 0.1, 0.2)
    points = spark.createDataFrame([("a", *p) for p in pts], "object_id string, z int, y int, x int")
    targets = spark.createDataFrame([("a", "t", *p) for p in tgt], "object_id string, target string, z int, y int, x int")
    got = {(r.z, r.y, r.x): r.distance_um for r in distance.transform(targets, points, s).collect()}
    for p in pts:
        assert got[p] == pytest.approx(min(math.sqrt(sum(((a - b) * c) ** 2 for a, b, c in zip(p, t, s, strict=True))) for t in tgt))


def test_components_of_a_long_chain_and_lone_nodes(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in graph.components(nodes, links).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == k for k in range(41, 60))


def test_nearest_neighbour_of_lone_instance_is_null(spark):
    rows = [("a", "e", 1, 0.0, 0.0, 0.0), ("a", "e", 2, 0.0, 0.0, 5.0), ("a", "f", 3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "object_id string, entity string, label int, z double, y double, x double")
    got = {r.label: r[-1] for r in contacts.nearest_same_type(df, 1.0).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None}


def test_exact_p_against_all_splits(spark):
    a, b = [1.0, 2.0, 5.0, 6.0], [3.0, 4.0, 6.0, 8.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "group string, value double")
    pooled = a + b
    rank = [sum(x < v for x in pooled) + (sum(x == v for x in pooled) + 1) / 2 for v in pooled]
    centre = sum(rank) * len(a) / len(pooled)
    sums = [sum(c) for c in combinations(rank, len(a))]
    far = [abs(s - centre) >= abs(sum(rank[: len(a)]) - centre) - 1e-9 for s in sums]
    row = stats.mann_whitney(df).first()
    assert row.p == pytest.approx(sum(far) / len(sums))


def test_groups_of_one_or_all_alike_have_no_p(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", 1.0), ("c", 1.0), ("d", 1.0), ("d", 1.0)], "group string, value double")
    got = {(r.group_a, r.group_b): r.p for r in stats.mann_whitney(df).collect()}
    assert got["a", "b"] is None and got["c", "d"] is None


def test_names_and_nouns(spark):
    df = spark.createDataFrame([("My  Cell--01",), ("__a__",)], "s string")
    assert [r[0] for r in df.select(scalar.normal_name(F.col("s"))).collect()] == ["my_cell_01", "a"]
    assert scalar.plural("cells") == "cells" and scalar.plural("nucleus/nuclei") == "nuclei"
