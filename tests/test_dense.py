"""Contact graphs with far more edges than instances."""

import math
import random

from pyspark.sql import functions as F

from granula.operators import branches, contacts

KEYS = ["object_id", "entity"]


def instances(n=60, seed=3, copies=0):
    rng = random.Random(seed)
    rows = [(k % 2, 1, k, *(round(rng.random(), 3) for _ in "zyx")) for k in range(n)]
    return rows + [(o, e, k, *(round(rng.random(), 3) for _ in "zyx")) for o, e, k, *_ in rows[:copies]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "object_id long, entity long, label long, z double, y double, x double")


def plain_pairs(rows, reach):
    out = {}
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2] and (gap := math.dist(a[3:], b[3:])) <= reach:
                key = (*a[:2], a[2], b[2])
                out[key] = min(gap, out.get(key, gap))
    return {k: round(v, 9) for k, v in out.items()}


def test_pairs_of_instances_with_one_and_with_several_points(spark):
    rows = instances(copies=20)
    got = contacts.contact_pairs(frame(spark, rows).withColumn("tag", F.col("label") * 10), 0.3, ("tag",)).collect()
    assert {(r.object_id, r.entity, r.label_a, r.label_b): round(r.gap_um, 9) for r in got} == plain_pairs(rows, 0.3) and len(got) == len(plain_pairs(rows, 0.3))
    assert all((r.tag_a, r.tag_b) == (10 * r.label_a, 10 * r.label_b) for r in got)


def test_edges_between_junctions_are_not_contracted(spark, monkeypatch):
    i = frame(spark, instances(120)).localCheckpoint()
    pairs = contacts.contact_pairs(i, 0.25)
    plain = pairs.select(*KEYS, F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    vertices = i.withColumnRenamed("label", "v")
    degree = branches.degrees(branches.darts(plain, KEYS), KEYS).localCheckpoint()
    edges = contacts.contact_pairs(i.join(degree.withColumnRenamed("v", "label"), [*KEYS, "label"]), 0.25, ("degree",)).withColumnsRenamed({"label_a": "a", "label_b": "b"})
    names = [*KEYS, "s", "s1", "t1", "t", "n", "length_um", "arc_um", "chord_um"]
    rows = lambda df, cols: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    whole, seen = rows(branches.shapes(branches.chains(plain, KEYS), vertices, KEYS), names), []
    chains = branches.chains
    monkeypatch.setattr(branches, "chains", lambda e, *more: (seen.append(e.count()), chains(e, *more))[1])
    assert rows(branches.dense_shapes(edges, vertices, degree, KEYS), names) == whole and any(r[6] > 1 for r in whole)
    assert seen[0] <= 2 * degree.where("degree = 2").count() < plain.count()
    measured = [*KEYS, "instance_branches", "instance_length_um", "instance_tortuosity"]
    assert rows(branches.dense_metrics(edges, vertices, degree, KEYS), measured) == rows(branches.metrics(plain, vertices, KEYS), measured)


def test_clusters_by_cells_are_those_of_all_pairs(spark):
    rng, rows = random.Random(5), []
    for o, centre in enumerate((0.0, 0.09, 0.2, 0.35, 0.5)):  # clumps at distances around the reach, and outliers
        rows += [(0, 1, 100 * o + k, *(round(centre + rng.uniform(-0.01, 0.01), 6) if a == "z" else round(rng.uniform(0, 0.02), 6) for a in "zyx")) for k in range(25)]
    rows += [(1, 1, 1000 + k, *(round(rng.uniform(-0.5, 0.5), 6) for _ in "zyx")) for k in range(150)]
    rows += [(1, 1, 2000, 0.1, 0.1, 0.1), (1, 1, 2001, 0.1, 0.1, 0.1), (1, 2, 2002, 0.1, 0.1, 0.1), (1, 1, 2003, None, 0.1, 0.1), (1, 1, 2004, math.nan, 0.0, 0.0), (1, 1, 2005, math.inf, 0.0, 0.0)]
    rows += [(2, 1, 3000, 0.0, 0.0, 0.0), (2, 1, 3001, 0.12, 0.0, 0.0), (2, 1, 3002, 0.240001, 0.0, 0.0)]
    i = frame(spark, rows)
    found = lambda df: sorted(tuple(r) for r in df.select(*KEYS, "label", "cluster").collect())
    near = i.where("label <> 2005").localCheckpoint()  # grid cells of pairs have no infinite place
    plain = sorted([*found(contacts.clusters(near, contacts.contact_pairs(near, 0.12), 0.12)), (1, 1, 2005, 2005)])
    assert found(contacts.near_clusters(i, 0.12)) == plain and len(plain) == len(rows)
    assert len({r[3] for r in plain if r[0] == 0}) == 3 and [r[3] for r in plain if r[0] == 2] == [3000, 3000, 3002]


def test_spurs_of_dense_graphs_are_cut_without_their_edges(spark, monkeypatch):
    rng, edges, n = random.Random(8), set(), 40
    for g in (0, 1):  # a dense core; trees of several depths on it, so junctions turn into parts of chains, and a tree of its own
        edges |= {(g, a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        edges |= {(g, rng.randrange(n if v < n + 25 else v), v) for v in range(n, n + 70)}
        edges |= {(g, 200 + rng.randrange(k), 200 + k) for k in range(1, 15)}
        edges |= {(g, 300 + k, 301 + k) for k in range(5)} | {(g, 300, 305)} | {(g, 300, 310), (g, 310, 311), (g, 311, 312), (g, 311, 313), (g, 400, 401)}
    names = sorted({(g, v) for g, *ends in edges for v in ends})
    vertices = spark.createDataFrame([(g, 1, v, *(rng.random() for _ in "zyx"), rng.choice([0.0, 0.4, 0.9, 3.0])) for g, v in names], "object_id long, entity long, v long, z double, y double, x double, radius double")
    whole = spark.createDataFrame([(g, 1, a, b) for g, a, b in edges], "object_id long, entity long, a long, b long").localCheckpoint()
    degree = branches.degrees(branches.darts(whole, KEYS), KEYS).localCheckpoint()
    asked, sizes, stored = [], [], branches.stored

    def edges_at(marks):
        asked.append(marks.count())
        return whole.join(marks, (whole.object_id == marks.object_id) & ((whole.a == marks.v) | (whole.b == marks.v)), "left_semi")

    monkeypatch.setattr(branches, "stored", lambda df, name: (sizes.append((out := stored(df, name)).count()), out)[1])
    bare = {(r.object_id, r.v) for r in branches.dense_spurs(edges_at, vertices, degree, KEYS).collect()}
    monkeypatch.undo()
    kept = {(r.object_id, r.a, r.b) for r in branches.pruned(whole, vertices, KEYS).collect()}
    assert {(g, a, b) for g, a, b in edges if (g, a) not in bare and (g, b) not in bare} == kept and len(kept) < len(edges)
    assert len(asked) > 2 and asked[1] > 0 and max(sizes) < len(edges) / 2
