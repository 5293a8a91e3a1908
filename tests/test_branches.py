"""Branches, measures and spur pruning of many graphs at once against plain walks."""

import random

import numpy as np
import pytest

from granula.operators import branches, skeleton

GRAPHS = 1000


def plain_pruned(points, edges, radii, factor):
    """Round by round: the short ends of all junctions, each junction's shortest first while it has three arms."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while True:
        found = []
        for tip in sorted(near):
            if len(near[tip]) != 1:
                continue
            way, length = [tip], 0.0
            while len(near[way[-1]]) < 3:
                ahead = near[way[-1]] - set(way[-2:-1])
                if not ahead:
                    break
                way.append(min(ahead))
                length += float(np.linalg.norm(points[way[-1]] - points[way[-2]]))
            if len(near[way[-1]]) > 2 and length < factor * radii[way[-1]]:
                found.append((length, tip, way))
        done = False
        for _, _, way in sorted(found):
            if len(near[way[-1]]) > 2:
                near[way[-1]].discard(way[-2])
                for v in way[:-1]:
                    near[v] = set()
                done = True
        if not done:
            return sorted((a, b) for a in near for b in near[a] if a < b)


@pytest.fixture(scope="module")
def graphs():
    out = {}
    for g in range(GRAPHS):
        rng, n = random.Random(g), random.Random(g).randint(1, 25)
        points = np.round(np.cumsum(np.random.default_rng(g).normal(size=(n, 3)), 0), 3)
        edges = [(rng.randint(max(0, k - 4), k - 1), k) for k in range(1, n)]
        if g % 3 == 0 and n > 3:  # some with a loop
            edges = sorted({*edges, (0, n - 1)})
        if g % 50 == 0:  # nothing but a loop
            edges = [(k, k + 1) for k in range(n - 1)] + [(0, n - 1)] * (n > 2)
        out[g] = points, edges, [round(rng.random() * 2, 2) for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def tables(spark, graphs):
    v = [(g, k, *map(float, p), r) for g, (points, _, radii) in graphs.items() for k, (p, r) in enumerate(zip(points, radii, strict=True))]
    e = [(g, a, b, "x") for g, (_, edges, _) in graphs.items() for a, b in edges]
    return spark.createDataFrame(e, "g int, a int, b int, s string"), spark.createDataFrame(v, "g int, v int, z double, y double, x double, radius double")


def test_measures_of_a_thousand_graphs(tables, graphs):
    edges, vertices = tables
    found = {r.g: r for r in branches.metrics(edges, vertices, ["g"]).collect()}
    assert len(found) == GRAPHS
    for g, (points, e, _) in graphs.items():
        n, length, bent = skeleton.graph_metrics(points, np.array(e, int).reshape(-1, 2))
        assert found[g].instance_branches == n and found[g].instance_length_um == pytest.approx(length)
        assert found[g].instance_tortuosity == (None if bent is None else pytest.approx(bent))


@pytest.mark.parametrize("factor", [0.0, 1.0, 2.0])
def test_pruning_of_a_thousand_graphs(tables, graphs, factor):
    edges, vertices = tables
    found = {g: [] for g in graphs}
    for r in branches.pruned(edges, vertices, ["g"], factor).collect():
        found[r.g].append((r.a, r.b))
    assert {g: sorted(e) for g, e in found.items()} == {g: plain_pruned(*graph, factor) for g, graph in graphs.items()}
    some = [g for g in graphs if graphs[g][1]][:200]
    assert all(sorted(map(tuple, skeleton.pruned(graphs[g][0], np.array(graphs[g][1]), graphs[g][2], factor).tolist())) == sorted(found[g]) for g in some)


def _frames(spark, points, edges, radius=1.0):
    v = spark.createDataFrame([(1, k, *map(float, p), radius) for k, p in enumerate(points)], "label int, v int, z double, y double, x double, radius double")
    return spark.createDataFrame([(1, a, b) for a, b in edges], "label int, a int, b int"), v


@pytest.mark.parametrize(
    "points,edges,want",
    [
        ([(0, 0, k) for k in range(5)], [(k, k + 1) for k in range(4)], (1, 4.0, 1.0)),
        ([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, -1, 0)], [(0, 1), (1, 2), (2, 3), (2, 4)], (3, 2 + 2 * 2**0.5, 1.0)),
        ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1), (1, 2), (2, 3), (3, 0)], (1, 4.0, None)),
        ([(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 9, 0), (0, 9, 1)], [(0, 1), (1, 2), (3, 4)], (2, 3.0, 1.0)),
        ([(0, 0, 0)], [], (0, 0.0, None)),
        ([(0, 0, 0), (0, 0, 3)], [(0, 1), (1, 0), (0, 1), (0, 0)], (1, 3.0, 1.0)),
    ],
)
def test_known_shapes(spark, points, edges, want):
    row = branches.metrics(*_frames(spark, points, edges), ["label"]).first()
    assert (row.instance_branches, row.instance_length_um) == (want[0], pytest.approx(want[1]))
    assert row.instance_tortuosity == (want[2] if want[2] is None else pytest.approx(want[2]))


def test_a_quarter_circle_and_a_staircase(spark):
    angle = np.linspace(0, np.pi / 2, 40)
    chain = [(k, k + 1) for k in range(39)]
    curved = branches.metrics(*_frames(spark, np.column_stack([np.cos(angle), np.sin(angle), 0 * angle]), chain), ["label"]).first()
    assert curved.instance_tortuosity == pytest.approx(np.pi / 2 / 2**0.5, abs=0.02)
    stairs = [p for k in range(12) for p in ((k, k, 0), (k + 1, k, 0))]
    bent = branches.metrics(*_frames(spark, stairs, [(k, k + 1) for k in range(23)]), ["label"]).first().instance_tortuosity
    assert 1.0 <= bent < 1.2


def test_a_star_of_spurs_keeps_a_path(spark):
    e, v = _frames(spark, [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1)], [(0, k) for k in range(1, 5)], 5.0)
    assert sorted((r.a, r.b) for r in branches.pruned(e, v, ["label"]).collect()) == [(0, 3), (0, 4)]


def test_a_chain_of_thousands_and_empty_tables(spark):
    n = 5000
    e, v = _frames(spark, [(0, 0, k) for k in range(n)], [(k, k + 1) for k in range(n - 1)])
    row = branches.shapes(branches.chains(e, ["label"]), v, ["label"]).first()
    assert (row.s, row.t, row.n, row.length_um, row.chord_um) == (0, n - 1, n - 1, n - 1.0, n - 1.0)
    nothing = e.where("false")
    assert branches.chains(nothing, ["label"]).count() == 0 and branches.pruned(nothing, v, ["label"]).count() == 0
    assert tuple(branches.metrics(nothing, v, ["label"]).first()) == (1, 0, 0.0, None)
    assert branches.metrics(nothing, v.where("false"), ["label"]).count() == 0
