"""Graph measures of one centre line: chains, length, tortuosity, tips and spur pruning.

The kernels take one skeleton (vertices in micrometres, edges, radii); ``branches`` has the same
measures over tables of vertices and edges, for skeletons of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from granula.functions.storage import spread
from granula.operators.branches import PASSES, SPUR_FACTOR, WINDOW


def _neighbours(n: int, edges: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges.tolist():
        out[a].append(b)
        out[b].append(a)
    return out


def chains(n: int, edges: np.ndarray) -> list[list[int]]:
    """Maximal runs between vertices whose degree is not 2; a whole graph without such a vertex is one loop."""
    near = _neighbours(n, edges)
    nodes = [v for v in range(n) if near[v] and len(near[v]) != 2]
    loop = not nodes
    if loop:
        nodes = [next((v for v in range(n) if near[v]), -1)]
        if nodes == [-1]:
            return []
    stops, used, out = set(nodes), set(), []
    for start in nodes:
        for step in near[start]:
            if (start, step) in used:
                continue
            run, before, at = [start, step], start, step
            while at not in stops:
                before, at = at, next(w for w in near[at] if w != before)
                run.append(at)
            used.update([(run[0], run[1]), (run[-1], run[-2])])
            out.append(run)
            if loop:
                return out
    return out


def tips(n: int, edges: np.ndarray) -> list[int]:
    return np.flatnonzero(np.bincount(edges.ravel(), minlength=n) == 1).tolist() if len(edges) else []


def cable_length(vertices: np.ndarray, edges: np.ndarray) -> float:
    return float(np.linalg.norm(vertices[edges[:, 0]] - vertices[edges[:, 1]], axis=1).sum()) if len(edges) else 0.0


def _smoothed(points: np.ndarray) -> np.ndarray:
    """Moving means of WINDOW points to either side, PASSES times; the ends stay."""
    for _ in range(PASSES):
        inner = [points[max(0, k - WINDOW) : k + WINDOW + 1].mean(axis=0) for k in range(1, len(points) - 1)]
        points = np.vstack([points[:1], *[p[None] for p in inner], points[-1:]])
    return points


def graph_metrics(vertices: np.ndarray, edges: np.ndarray) -> tuple[int, float, float | None]:
    """(branches, cable length, tortuosity): the arc-weighted mean of arc over chord of the smoothed chains; none: 0, 0.0, None."""
    runs = chains(len(vertices), edges)
    total = weighted = 0.0
    for run in runs:
        p = _smoothed(vertices[run])
        arc, chord = np.linalg.norm(np.diff(p, axis=0), axis=1).sum(), np.linalg.norm(p[-1] - p[0])
        if chord > 0:
            total, weighted = total + arc, weighted + arc * arc / chord
    return len(runs), cable_length(vertices, edges), weighted / total if total else None


def pruned(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray, factor: float = SPUR_FACTOR) -> np.ndarray:
    """Edges without end chains shorter than factor times the radius at their junction.

    In a round each junction cuts its shortest (ties by the end) and keeps two arms; rounds go on until none is left.
    """
    edges = edges.copy()
    while len(edges) and factor > 0:
        degree, spurs = np.bincount(edges.ravel(), minlength=len(vertices)), {}
        for run in chains(len(vertices), edges):
            run = run if degree[run[0]] == 1 else run[::-1]
            if degree[run[0]] == 1 and degree[run[-1]] > 2:
                length = np.linalg.norm(np.diff(vertices[run], axis=0), axis=1).sum()
                if length < factor * radii[run[-1]]:
                    spurs.setdefault(run[-1], []).append((length, run))
        gone = {frozenset(p) for junction, found in spurs.items() for _, run in sorted(found)[: degree[junction] - 2] for p in zip(run, run[1:], strict=False)}
        if not gone:
            break
        edges = np.array([e for e in edges.tolist() if frozenset(e) not in gone], int).reshape(-1, 2)
    return edges


def plane_graph(mask: np.ndarray, spacing=(1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices in micrometres, edges, radii) of the thinned centre line of a plane: edges to the eight neighbours, each once.

    A diagonal is left out where a step along the two sides joins the same pixels.
    """
    from granula.operators.geometry import edt
    from granula.operators.volumes import thinned

    line = thinned(mask)
    at = np.argwhere(line)
    number = np.full(np.array(mask.shape) + 2, -1)
    number[tuple((at + 1).T)] = np.arange(len(at))
    edges = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        other = number[tuple((at + 1 + [dy, dx]).T)]
        keep = other >= 0
        if dy and dx:
            keep &= (number[tuple((at + 1 + [dy, 0]).T)] < 0) & (number[tuple((at + 1 + [0, dx]).T)] < 0)
        edges.append(np.stack([np.flatnonzero(keep), other[keep]], 1))
    depth = edt(np.pad(mask, 1), spacing)[1:-1, 1:-1]
    return at * np.array(spacing), np.concatenate(edges), depth[tuple(at.T)]


def traced(mask: np.ndarray, spacing=(1.0, 1.0, 1.0), scale: float = 3.0, const: float | None = None, exponent: float = 4.0, penalty: float = 1e5, dust: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices in micrometres, edges, radii) of the centre lines of one volume.

    Paths run from the voxel farthest from a root through voxels far from the boundary; those
    around a path, nearer than ``scale`` times its radius plus ``const``, are done with, and
    the farthest of the rest gives the next path, until none is left. ``const`` is six voxels
    of the coarsest axis by default; parts of ``dust`` voxels or fewer have no line.
    """
    import heapq

    from granula.operators.bricks import roots_of
    from granula.operators.geometry import edt
    from granula.operators.graph import neighbour_offsets

    spacing = np.asarray(spacing, float)
    const = 6 * spacing.max() if const is None else const
    wide = np.pad(mask.astype(bool), 1)
    at = np.argwhere(wide)
    n = len(at)
    number = np.full(wide.shape, -1)
    number[tuple(at.T)] = np.arange(n)
    near, length = [], []
    for o in neighbour_offsets(3):
        near.append(number[tuple((at + np.array(o)).T)])
        length.append(float(np.linalg.norm(np.array(o) * spacing)))
    near = np.stack(near, 1) if n else np.zeros((0, 26), int)
    depth = edt(wide, spacing)[tuple(at.T)]
    link = np.argwhere(near >= 0)
    part = roots_of(n, link[:, 0], near[link[:, 0], link[:, 1]]) if n else np.zeros(0, int)
    points = (at - 1) * spacing
    rows, adjacency = near.tolist(), length

    def spread(start: int, cost) -> tuple[np.ndarray, np.ndarray]:
        best, before = np.full(n, np.inf), np.full(n, -1)
        best[start] = 0.0
        heap = [(0.0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k, b in enumerate(rows[a]):
                if b >= 0 and (e := d + adjacency[k] * cost[b]) < best[b]:
                    best[b], before[b] = e, a
                    heapq.heappush(heap, (e, b))
        return best, before

    used: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for root in np.unique(part).tolist():
        own = np.flatnonzero(part == root)
        if len(own) <= dust:
            continue
        flat = np.ones(n)
        start = int(own[np.argmax(spread(int(own[0]), flat)[0][own])])
        far = spread(start, flat)[0]
        steep = 1 + penalty * (1 - depth / (1.01 * depth[own].max())) ** exponent
        _, before = spread(start, steep)
        left = np.zeros(n, bool)
        left[own] = True
        used.setdefault(start, len(used))
        while left.any():
            tip = int(own[np.argmax(np.where(left[own], far[own], -1.0))])
            path = [tip]
            while path[-1] not in used and before[path[-1]] >= 0:
                path.append(int(before[path[-1]]))
            for v in path:
                used.setdefault(v, len(used))
            edges += [(used[a], used[b]) for a, b in zip(path, path[1:], strict=False)]
            rest = np.flatnonzero(left)
            for v in path:
                reach = scale * depth[v] + const
                close = ((points[rest] - points[v]) ** 2).sum(axis=1) <= reach * reach
                left[rest[close]] = False
                rest = rest[~close]
                if not len(rest):
                    break
            left[tip] = False
    order = np.array(list(used), int)
    return points[order] if len(order) else np.zeros((0, 3)), np.array(edges, int).reshape(-1, 2), depth[order] if len(order) else np.zeros(0)


def smoothed_line(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray, passes: int = 10, strength: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and radii after passes that move each vertex of two neighbours towards their middle; ends and junctions stay."""
    degree = np.bincount(edges.ravel(), minlength=len(vertices)) if len(edges) else np.zeros(len(vertices), int)
    inner = degree == 2
    whole = np.column_stack([vertices, radii]).astype(float)
    for _ in range(passes if inner.any() else 0):
        total = np.zeros_like(whole)
        np.add.at(total, edges[:, 0], whole[edges[:, 1]])
        np.add.at(total, edges[:, 1], whole[edges[:, 0]])
        whole[inner] += strength * (total[inner] / 2 - whole[inner])
    return whole[:, :-1], whole[:, -1]


def skeletons(voxels: DataFrame, spacing, factor: float = SPUR_FACTOR, cap: int = 500_000) -> DataFrame:
    """(object_id, entity, label, instance_branches, instance_length_um, instance_tortuosity, tips, skeleton) of each instance, traced in its own box grown by one.

    Three spacings trace volumes, two thin planes. Spurs shorter than ``factor`` radii are cut.
    An instance of more than ``cap`` box voxels is not traced: its measures are null, which is
    not the 0 of an instance without a line. ``tips`` are (z, y, x) in voxels.
    """
    import pyarrow as pa

    from granula.operators.geometry import encode_tube

    keys, flat = ["object_id", "entity", "label"], len(spacing) == 2
    axes = "yx" if flat else "zyx"
    size = np.asarray(spacing, float)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = np.stack([rows[a].to_numpy() for a in axes], 1).astype(np.int64)
        low = at.min(axis=0)
        shape = at.max(axis=0) - low + 1
        out = {k: pa.array([v.as_py()], rows.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        branches = length = tortuosity = ends = payload = None
        if shape.prod() <= cap:
            mask = np.zeros(shape, bool)
            mask[tuple((at - low).T)] = True
            vertices, edges, radii = plane_graph(mask, size) if flat else traced(mask, size)
            edges = pruned(vertices, edges, radii, factor) if len(edges) else edges
            branches, length, tortuosity = graph_metrics(vertices, edges)
            places = vertices / size + low
            ends = [[0.0] * (3 - len(axes)) + places[k].tolist() for k in tips(len(vertices), edges)]
            if len(edges):
                kept, moved = np.unique(edges.ravel(), return_inverse=True)
                line, wide = smoothed_line(vertices[kept] + low * size, moved.reshape(-1, 2), radii[kept])
                xyz = line[:, ::-1] if not flat else np.column_stack([line[:, 1], line[:, 0], np.zeros(len(line))])
                payload = encode_tube(xyz, moved.reshape(-1, 2), wide)
        kind = pa.list_(pa.list_(pa.float64()))
        more = {"instance_branches": (branches, pa.int32()), "instance_length_um": (length, pa.float64()), "instance_tortuosity": (tortuosity, pa.float64()), "tips": (ends, kind), "skeleton": (payload, pa.binary())}
        return pa.table(out | {k: pa.array([v], t) for k, (v, t) in more.items()})

    kinds = dict(voxels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", instance_branches int, instance_length_um double, instance_tortuosity double, tips array<array<double>>, skeleton binary"
    return spread(voxels, *keys).groupBy(*keys).applyInArrow(run, schema)
