"""Curve skeletons of voxel tables by thinning in bricks, and their graphs.

A turn takes the voxels that lie on the boundary when it begins, in eight sub-fields by the
parity of their coordinates; those of a sub-field are no neighbours, so all that are simple
and no ends can go at once without a change of topology. A voxel after a turn depends on
those up to REACH away, so a brick with a layer of REACH voxels for each turn gives the
same voxels as one task with the whole volume would. Rounds of TURNS turns are written to the
shared folder and go on with the instances that still lose voxels.

An instance whose box fits into one brick needs no rounds: centre_lines() thins, joins and
measures such instances in one pass, many of them at once, as each call costs more than
their voxels.

Defined results: repeated voxels count once; an instance of one voxel is one vertex; voxels
without neighbours stay; an empty table gives an empty result; other columns are dropped.
Coordinates lie in 0 .. 2 ** 20 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.storage import spread, stored, unsent
from granula.operators import branches, distance
from granula.operators.bricks import CELLS, ROWS, SIDE, box_cuts, bricked, whole_bricks
from granula.operators.flood import brick_dilated
from granula.operators.graph import neighbour_offsets

KEYS = ("object_id", "entity", "label")
REACH, TURNS = 9, 2
#: Steps of the finest axis up to which the nearest voxel outside is looked up offset by offset.
CLOSE = 6

_NEAR = np.array(neighbour_offsets(3))
_APART = np.abs(_NEAR[:, None] - _NEAR[None])
#: Which of the 26 neighbours touch each other, and over a face; which lie in the 18 and in the 6.
_TOUCH = ((_APART.max(axis=2) == 1)).astype(np.float32)
_FACE = ((_APART.sum(axis=2) == 1)).astype(np.float32)
_IN18, _IN6 = np.abs(_NEAR).sum(axis=1) <= 2, np.abs(_NEAR).sum(axis=1) == 1
_BITS = 1 << np.arange(len(_NEAR))


def _detours(to: tuple[int, ...]) -> list[int]:
    """Neighbours over which two steps, each before the step ``to`` in rank, lead there."""
    rank = lambda a, b: (sum(abs(p - q) for p, q in zip(a, b, strict=True)), min(a, b), max(a, b))
    none = (0,) * len(to)
    apart = [max(abs(p - q) for p, q in zip(o, to, strict=True)) for o in neighbour_offsets(3)]
    return [k for k, o in enumerate(neighbour_offsets(3)) if apart[k] == 1 and max(rank(none, o), rank(o, to)) < rank(none, to)]


#: The offsets of graph_of() by number, each with its detours.
_STEPS = [(neighbour_offsets(3).index(o), _detours(o)) for o in neighbour_offsets(3, half=True)]


def _joined(members: np.ndarray, start: np.ndarray, links: np.ndarray) -> np.ndarray:
    """What of ``members`` (rows of flags) the first flag of ``start`` reaches over ``links``."""
    reached = np.zeros_like(members)
    some = np.flatnonzero(start.any(axis=1))
    reached[some, start[some].argmax(axis=1)] = True
    while True:
        after = reached | (members & ((reached.astype(np.float32) @ links) > 0))
        if (after == reached).all():
            return reached
        reached = after


def simple(near: np.ndarray) -> np.ndarray:
    """Whether a voxel with these 26 neighbours (rows of flags) can go: one part of the object and one of the outside touch it."""
    one = (_joined(near, near, _TOUCH) == near).all(axis=1) & near.any(axis=1)
    open_ = ~near & _IN18
    faces = open_ & _IN6
    return one & ((_joined(open_, faces, _FACE) & faces) == faces).all(axis=1) & faces.any(axis=1)


def _turned(flat: np.ndarray, index: np.ndarray, steps: np.ndarray, field: np.ndarray) -> None:
    """One turn, in place, on the voxels ``index`` of ``flat``; ``steps`` lead from each to its neighbours, ``field`` is its sub-field."""
    border = ~flat[index[:, None] + steps[:, _IN6]].all(axis=1)
    index, steps, field = index[border], steps[border], field[border]
    for k in range(8):
        here = field == k
        own = index[here]
        near = flat[own[:, None] + steps[here]]
        inside = near.sum(axis=1) > 1
        own, near = own[inside], near[inside]
        _, first, pattern = np.unique(near @ _BITS, return_index=True, return_inverse=True)
        flat[own[simple(near[first])[pattern]]] = False


def turn(mask: np.ndarray, low: Sequence[int]) -> np.ndarray:
    """One turn on a dense block whose first voxel is ``low``; its outer layer is kept."""
    mask = mask.copy()
    steps = _NEAR @ np.array([mask.shape[1] * mask.shape[2], mask.shape[2], 1])
    at = np.argwhere(mask)
    at = at[((at > 0) & (at < np.array(mask.shape) - 1)).all(axis=1)]
    index = np.ravel_multi_index(tuple(at.T), mask.shape) if len(at) else np.empty(0, np.int64)
    _turned(mask.reshape(-1), index, np.broadcast_to(steps, (len(at), len(steps))), ((at + np.array(low)) % 2) @ np.array([4, 2, 1]))
    return mask


class Boxes:
    """Dense boxes of whole instances, laid end to end with a layer around each; ``heads`` are the first rows of the instances in ``at``."""

    def __init__(self, at: np.ndarray, heads: np.ndarray):
        self.low = np.minimum.reduceat(at, heads) - 1
        self.shape = np.maximum.reduceat(at, heads) + 2 - self.low
        self.pitch = np.stack([self.shape[:, 1] * self.shape[:, 2], self.shape[:, 2], np.ones(len(heads), np.int64)], 1)
        self.size = self.shape.prod(axis=1)
        self.base = np.cumsum(self.size) - self.size
        of = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(at)))
        self.flat = np.zeros(self.size.sum(), bool)
        self.flat[self.base[of] + ((at - self.low[of]) * self.pitch[of]).sum(axis=1)] = True
        self.solid = self.flat.copy()

    def voxels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, number of the instance and place of each voxel that is left."""
        index = np.flatnonzero(self.flat)
        of = np.searchsorted(self.base, index, "right") - 1
        at, rest = np.empty((len(index), 3), np.int64), index - self.base[of]
        for k in range(3):
            at[:, k], rest = np.divmod(rest, self.pitch[of, k])
        return index, of, at + self.low[of]

    def thin(self) -> None:
        """Turns on all instances, until each loses no more."""
        index, of, at = self.voxels()
        field, steps = (at % 2) @ np.array([4, 2, 1]), self.pitch @ _NEAR.T
        while len(index):
            _turned(self.flat, index, steps[of], field)
            there, lost = self.flat[index], np.zeros(len(self.base), bool)
            lost[of[~there]] = True
            on = there & lost[of]
            index, of, field = index[on], of[on], field[on]

    def links(self, index: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the edges of graph_of() as places in ``index``, by rising first end."""
        steps = self.pitch @ _NEAR.T
        a, b = [], []
        for k, over in _STEPS:
            there = np.flatnonzero(self.flat[index + steps[of, k]])
            there = there[~self.flat[index[there, None] + steps[of[there]][:, over]].any(axis=1)]
            a.append(there)
            b.append(np.searchsorted(index, index[there] + steps[of[there], k]))
        order = np.argsort(np.concatenate(a), kind="stable")
        return np.concatenate(a)[order], np.concatenate(b)[order]

    def depths(self, index: np.ndarray, of: np.ndarray, at: np.ndarray, spacing: Sequence[float]) -> np.ndarray:
        """Distance of voxels to the nearest one outside their instance, as distance.transform() adds it up.

        Offsets of rising length are tried up to CLOSE steps; instances with deeper voxels take the
        transform of their box. A voxel beyond the box is never the nearest.
        """
        spacing = np.asarray(spacing, float)
        most = CLOSE * spacing.min() * (1 + 1e-9)
        offsets = np.array(list(product(*[range(-int(most / s), int(most / s) + 1) for s in spacing])))
        length = ((offsets * spacing) ** 2).sum(axis=1)
        order = np.argsort(length, kind="stable")
        order = order[(length[order] > 0) & (length[order] <= most**2)]
        offsets, length = offsets[order], length[order]
        found, todo = np.full(len(index), np.inf), np.arange(len(index))
        for group in np.split(np.arange(len(offsets)), np.flatnonzero(np.diff(length) > 1e-9 * length[1:]) + 1):
            if not len(todo):
                break
            out = ~self.solid[index[todo, None] + self.pitch[of[todo]] @ offsets[group].T]
            row, o = np.nonzero(out)
            here = at[todo[row]]
            z, y, x = ((here * spacing - (here + offsets[group[o]]) * spacing) ** 2).T
            np.minimum.at(found, todo[row], x + y + z)
            todo = todo[~out.any(axis=1)]
        for k in np.unique(of[todo]):
            span = slice(self.base[k], self.base[k] + self.size[k])
            cost = np.where(self.solid[span], np.inf, 0.0).reshape(self.shape[k])
            for axis in (2, 1, 0):
                line = (self.low[k, axis] + np.arange(self.shape[k, axis])) * spacing[axis]
                lines = np.moveaxis(cost, axis, 0)
                cost = np.moveaxis(distance.lower_envelope(lines.reshape(len(line), -1), line, line).reshape(lines.shape), 0, axis)
            own = todo[of[todo] == k]
            found[own] = cost[tuple((at[own] - self.low[k]).T)]
        return np.sqrt(found)


def whole_lines(voxels: DataFrame, spacing: Sequence[float], keys: Sequence[str] = KEYS, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(keys, v, z, y, x, radius, ends) of ``voxels``, dealt and sorted by ``keys``: the thinned voxels of each instance, and the later ends of their edges."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads in whole_bricks(batches, keys, rows):
            at = np.stack([table[c].to_numpy() for c in "zyx"], 1).astype(np.int64)
            cuts = box_cuts(at, heads, cells)
            ends = np.append(heads, len(table))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                boxes = Boxes(at[ends[lo] : ends[hi]], heads[lo:hi] - ends[lo])
                boxes.thin()
                index, of, left = boxes.voxels()
                code = left @ np.array([2**40, 2**20, 1])
                a, b = boxes.links(index, of)
                first = np.searchsorted(a, np.arange(len(index) + 1)).astype(np.int32)
                out = table.select(keys).take(pa.array(heads[lo:hi][of])).combine_chunks().append_column("v", pa.array(code))
                for k, c in enumerate("zyx"):
                    out = out.append_column(c, pa.array(left[:, k], pa.int32()))
                out = out.append_column("radius", pa.array(boxes.depths(index, of, left, spacing)))
                yield from out.append_column("ends", pa.ListArray.from_arrays(pa.array(first), pa.array(code[b]))).to_batches()

    kind = dict(voxels.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "v long, z int, y int, x int, radius double, ends array<long>"])
    return voxels.select(*keys, *"zyx").mapInArrow(run, schema)


def thinned(voxels: DataFrame, keys: Sequence[str] = KEYS, side: int = SIDE, turns: int = TURNS, name: str = "thinned") -> DataFrame:
    """(keys, z, y, x): the voxels of ``voxels`` that are left when no more can go, each instance by itself."""
    keys, halo = list(keys), REACH * turns

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        corner = np.array([k.as_py() for k in key[len(keys) :]]) * side
        at = np.stack([rows[a].to_numpy() for a in "zyx"], 1).astype(np.int64)
        if not ((at >= corner) & (at < corner + side)).all(axis=1).any():  # only the layer of others
            at = at[:0]
        low, high = (at.min(axis=0) - 1, at.max(axis=0) + 1) if len(at) else (corner, corner)
        mask = np.zeros(high - low + 1, bool)
        mask[tuple((at - low).T)] = True
        for _ in range(turns):
            mask = turn(mask, low)
        left = np.argwhere(mask) + low
        left = left[((left >= corner) & (left < corner + side)).all(axis=1)]
        out = {k: pa.array([v.as_py()] * len(left), rows.schema.field(k).type) for k, v in zip(keys, key, strict=False)}
        return pa.table(out | {c: pa.array(left[:, k], pa.int32()) for k, c in enumerate("zyx")})

    kind = dict(voxels.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "z int", "y int", "x int"])
    names = ["bz", "by", "bx"]
    size = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    live = stored(voxels.select(*keys, *[F.col(a).cast("int").alias(a) for a in "zyx"]).distinct(), f"{name}-live")
    settled = None
    while True:
        rows = bricked(live, side, halo=(halo,) * 3)
        after = stored(spread(rows, *keys, *names).groupBy(*keys, *names).applyInArrow(run, schema), f"{name}-live")
        less = size(live).withColumnRenamed("n", "was").join(size(after), keys).where("n < was").select(*keys)
        less = stored(less, f"{name}-keys")
        still = after.join(less, keys, "left_anti")
        settled = still if settled is None else settled.unionByName(still)
        if less.isEmpty():
            return settled
        live = stored(after.join(less, keys, "left_semi"), f"{name}-live")


def graph_of(line: DataFrame, keys: Sequence[str] = KEYS, name: str = "line") -> tuple[DataFrame, DataFrame]:
    """(vertices (keys, v, z, y, x), edges (keys, a, b)) of thin voxels: neighbours are joined, but of three that touch each other the longest step is left out."""
    keys = list(keys)
    code = lambda z, y, x: (z.cast("long") * F.lit(2**40) + y.cast("long") * F.lit(2**20) + x.cast("long"))
    vertices = stored(line.select(*keys, code(*map(F.col, "zyx")).alias("v"), "z", "y", "x"), f"{name}-vertices")
    half = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip("zyx", o, strict=True)], F.lit(sum(map(abs, o))).alias("w")) for o in neighbour_offsets(3, half=True)])
    there = vertices.select(*keys, F.col("v").alias("a"), "z", "y", "x", F.explode(half).alias("o"))
    there = there.select(*keys, "a", code(*[F.col(c) + F.col(f"o.d{c}") for c in "zyx"]).alias("b"), F.col("o.w").alias("w"))
    steps = stored(there.join(vertices.select(*keys, F.col("v").alias("b")), [*keys, "b"]).select(*keys, "a", "b", "w"), f"{name}-steps")
    both = steps.select(*keys, "a", "b", F.struct("w", "a", "b").alias("rank")).union(steps.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), F.struct("w", "a", "b")))
    x = both.select(*keys, "a", F.col("b").alias("c"), F.col("rank").alias("r1"))
    y = both.select(*keys, F.col("a").alias("c"), "b", F.col("rank").alias("r2"))
    around = x.join(unsent(y), [*keys, "c"]).where(F.col("a") < F.col("b"))  # 26 neighbours at most
    longest = steps.withColumn("rank", F.struct("w", "a", "b")).join(around, [*keys, "a", "b"]).where((F.col("r1") < F.col("rank")) & (F.col("r2") < F.col("rank")))
    return vertices, steps.select(*keys, "a", "b").join(longest.select(*keys, "a", "b").distinct(), [*keys, "a", "b"], "left_anti")


def radii(vertices: DataFrame, voxels: DataFrame, spacing: Sequence[float], keys: Sequence[str] = KEYS, name: str = "radius") -> DataFrame:
    """``vertices`` with ``radius``: the distance to the nearest voxel outside the own instance."""
    keys = list(keys)
    one = F.to_json(F.struct(*keys))
    own = voxels.select(one.alias("object_id"), "z", "y", "x").distinct()
    edge = brick_dilated(own, 1, ["object_id"]).join(unsent(own), ["object_id", "z", "y", "x"], "left_anti").withColumn("target", F.lit("out"))
    points = vertices.select(one.alias("object_id"), "z", "y", "x")
    found = distance.transform(edge, points, spacing, name).select("object_id", "z", "y", "x", F.col("distance_um").alias("radius"))
    return vertices.withColumn("object_id_", one).join(found.withColumnRenamed("object_id", "object_id_"), ["object_id_", "z", "y", "x"]).select(*keys, "v", "z", "y", "x", "radius")


def centre_lines(voxels: DataFrame, spacing: Sequence[float], keys: Sequence[str] = KEYS, factor: float = branches.SPUR_FACTOR, side: int = SIDE, name: str = "centre") -> tuple[DataFrame, DataFrame]:
    """(vertices (keys, v, z, y, x, radius) in micrometres, edges (keys, a, b)) of every instance's centre line without spurs.

    Instances whose box is at most ``side`` voxels wide are worked on whole; the others go by bricks and rounds.
    """
    keys = list(keys)
    live = stored(voxels.select(*keys, *[F.col(a).cast("int").alias(a) for a in "zyx"]), f"{name}-voxels")
    fits = reduce(lambda p, q: p & q, [F.max(a) - F.min(a) < side for a in "zyx"])
    fits = fits & reduce(lambda p, q: p & q, [F.first(F.col(k).isNotNull()) for k in keys])  # rows without a key meet none in joins
    boxes = stored(live.groupBy(*keys).agg(fits.alias("whole")), f"{name}-boxes")
    small = boxes.where("whole").select(*keys)
    parted = not boxes.where("not whole").isEmpty()
    rows = live.join(unsent(small), keys, "left_semi") if parted else live
    found = stored(whole_lines(spread(rows, *keys).sortWithinPartitions(*keys), spacing, keys), f"{name}-whole")
    wide, edges = found.select(*keys, "v", "z", "y", "x", "radius"), found.select(*keys, F.col("v").alias("a"), F.explode("ends").alias("b"))
    if parted:
        large = live.join(unsent(small), keys, "left_anti")
        vertices, more = graph_of(thinned(large, keys, side, name=name), keys, name)
        wide = wide.unionByName(radii(vertices, large, spacing, keys, f"{name}-radius"))
        edges = edges.unionByName(more)
    placed = stored(wide.select(*keys, "v", *[(F.col(a) * s).alias(a) for a, s in zip("zyx", spacing, strict=True)], "radius"), f"{name}-vertices")
    left = stored(branches.pruned(edges, placed, keys, factor, f"{name}-pruned"), f"{name}-edges")
    ends = left.select(*keys, F.col("a").alias("v")).union(left.select(*keys, "b"))
    lone = edges.select(*keys).distinct()
    return placed.join(ends.distinct(), [*keys, "v"], "left_semi").unionByName(placed.join(lone, keys, "left_anti")), left
