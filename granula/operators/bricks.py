"""Voxels in bricks with a halo: neighbourhood kernels whose cost is linear in the voxels.

A voxel goes to the brick that holds it and to those it borders on, so a brick knows all
neighbours of its own voxels. A brick of SIDE cubed bounds what one task holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.storage import spread

SIDE = 64
#: Voxels of whole bricks, and places of their boxes, that a task works on at once.
ROWS, CELLS = 50_000, 4_000_000


def bricked(voxels: DataFrame, side: int = SIDE, axes: str = "zyx", halo: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """``voxels`` with brick numbers bz, by, bx, a row for each brick that holds the voxel or has it within its halo."""
    for a, h in zip(axes, halo, strict=False):
        low, high = (F.floor((F.col(a) + d) / side).cast("int") for d in (-h, h))
        voxels = voxels.withColumn(f"b{a}", F.explode(F.sequence(low, high)))
    return voxels


class Brick:
    """Dense index of the voxels of one brick; ``own`` are those that lie inside it."""

    def __init__(self, coordinates: np.ndarray, corner: Sequence[int], side: int = SIDE, halo: Sequence[int] = (1, 1, 1)):
        self.at = coordinates
        dims = coordinates.shape[1]
        inner = coordinates - np.array(corner) * side  # the halo lies outside 0 .. side - 1
        self.own = ((inner >= 0) & (inner < side)).all(axis=1)
        pad = np.array(halo[:dims])
        self.low, self.high = inner.min(axis=0) - pad, inner.max(axis=0) + pad
        self.shape = tuple(self.high - self.low + 1)
        self.flat = np.ravel_multi_index(tuple((inner - self.low).T), self.shape)
        self.steps = [math.prod(self.shape[k + 1 :]) for k in range(dims)]

    def field(self, values: np.ndarray, empty: int) -> np.ndarray:
        out = np.full(math.prod(self.shape), empty, np.int64)
        out[self.flat] = values
        return out

    def step(self, offset: Sequence[int]) -> int:
        return sum(d * s for d, s in zip(offset, self.steps, strict=True))


def whole_bricks(batches: Iterable[pa.RecordBatch], names: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole bricks, ``rows`` long or more where there are as many, and the place of each brick's first row.

    ``batches`` are sorted by ``names``; no brick is parted. Bricks of few voxels are worked
    through many at once, as each call costs as much as thousands of voxels.
    """

    def heads(table: pa.Table) -> np.ndarray:
        new = np.arange(len(table)) == 0
        for c in names:
            code = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    need = rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(len(b) for b in held) >= need:
            table = pa.Table.from_batches(held).combine_chunks()
            first = heads(table)
            last = int(first[-1])
            if last:
                yield table.slice(0, last), first[:-1]
            held = table.slice(last).to_batches()
            need = rows if last else 2 * len(table)  # a long brick is not looked through again at every batch
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, heads(table)


def box_cuts(at: np.ndarray, heads: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Where to part bricks, whose first rows are ``heads``, so that the boxes of a part, with a layer around each, have about ``cells`` places."""
    extent = np.maximum.reduceat(at, heads) - np.minimum.reduceat(at, heads) + 3
    part = np.cumsum(extent.prod(axis=1)) // cells
    return np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(heads))


def _counted(at: np.ndarray, brick: np.ndarray, corner: np.ndarray, label: np.ndarray, code: np.ndarray, n: int, offsets: list[tuple[int, ...]], side: int) -> list[np.ndarray]:
    """Of each of ``n`` codes its own voxels, and those whose neighbour at each offset is of another label or none; ``brick`` rises from 0, with a row of ``corner`` each."""
    inner = at - corner[brick] * side
    own = ((inner >= 0) & (inner < side)).all(axis=1)
    first = np.flatnonzero(np.diff(brick, prepend=-1))
    low, high = np.minimum.reduceat(inner, first) - 1, np.maximum.reduceat(inner, first) + 1  # a layer around keeps bricks apart
    shape = high - low + 1
    steps = np.ones_like(shape)
    for k in range(shape.shape[1] - 1, 0, -1):
        steps[:, k - 1] = steps[:, k] * shape[:, k]
    size = shape.prod(axis=1)
    flat = (np.cumsum(size) - size)[brick] + ((inner - low[brick]) * steps[brick]).sum(axis=1)
    dense = np.full(size.sum(), -1, np.int32)
    dense[flat] = label
    flat, mine, code, steps = flat[own], label[own], code[own], np.ascontiguousarray(steps[brick[own]].T)
    return [np.bincount(code, minlength=n)] + [np.bincount(code[dense[flat + sum(d * s for d, s in zip(o, steps, strict=True) if d)] != mine], minlength=n) for o in offsets]


def intercepts(voxels: DataFrame, offsets: list[tuple[int, ...]], keys: list[str], axes: str = "zyx", side: int = SIDE, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(keys, label, n, c0, c1, ...): of each label its voxels, and those whose neighbour at each offset is of another label or none.

    Integer counts, so sums do not depend on how bricks are dealt. Bricks are counted together,
    about ``rows`` voxels and ``cells`` places of their boxes at once, or one brick.
    """
    names = [f"b{a}" for a in axes]
    counts = ["n", *(f"c{k}" for k in range(len(offsets)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads in whole_bricks(batches, [*keys, *names], rows):
            at, corner = (np.stack([table[c].to_numpy() for c in of], 1).astype(np.int64) for of in (axes, names))
            found, label = np.unique(table["label"].to_numpy(), return_inverse=True)
            ends = np.append(heads[1:], len(table))
            cuts = box_cuts(at, heads, cells)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                span = slice(heads[lo], ends[hi - 1])
                brick = np.repeat(np.arange(hi - lo), ends[lo:hi] - heads[lo:hi])
                pair, place, code = np.unique(brick * len(found) + label[span], return_index=True, return_inverse=True)
                got = _counted(at[span], brick, corner[heads[lo:hi]], label[span].astype(np.int32), code, len(pair), offsets, side)
                out = table.select([*keys, "label"]).take(pa.array(place + span.start)).combine_chunks()
                for c, v in zip(counts, got, strict=True):
                    out = out.append_column(c, pa.array(v, pa.int64()))
                yield from out.to_batches()

    kind = dict(voxels.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"label {kind['label']}", *(f"{c} long" for c in counts)])
    dealt = bricked(voxels.select(*keys, "label", *axes), side, axes)
    local = spread(dealt, *keys, *names).sortWithinPartitions(*keys, *names).mapInArrow(run, schema)
    return local.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in counts])


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def local_components(voxels: DataFrame, offsets: list[tuple[int, ...]], side: int = SIDE) -> DataFrame:
    """(object_id, entity, z, y, x, own, part): components within each brick, a part named by its first own voxel.

    Rows with ``own`` false are voxels of other bricks that touch the part.
    """
    keys, names = ["object_id", "entity"], ["bz", "by", "bx"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        brick = Brick(np.stack([rows[a].to_numpy() for a in "zyx"], 1).astype(np.int64), [k.as_py() for k in key[2:]], side)
        order = np.lexsort(brick.at.T[::-1])
        brick.at, brick.own, brick.flat = brick.at[order], brick.own[order], brick.flat[order]
        n = len(order)
        dense = brick.field(np.arange(n), -1)
        ends = [(np.flatnonzero(to >= 0), to[to >= 0]) for o in offsets for to in [dense[brick.flat + brick.step(o)]]]
        a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        inside = brick.own[a] & brick.own[b]
        root = roots_of(n, a[inside], b[inside])
        # an own voxel's root, and for the halo each root that it touches
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        touch = brick.own[x] & ~brick.own[y]
        pairs = np.unique(np.stack([y[touch], root[x[touch]]], 1), axis=0) if touch.any() else np.empty((0, 2), np.int64)
        own = np.flatnonzero(brick.own)
        at, part = np.concatenate([own, pairs[:, 0]]), np.concatenate([root[own], pairs[:, 1]])
        cells = {c: pa.array(brick.at[at, k], pa.int32()) for k, c in enumerate("zyx")}
        named = pa.StructArray.from_arrays([pa.array(brick.at[part, k], pa.int32()) for k in range(3)], ["z", "y", "x"])
        out = {k: pa.array([v] * len(at), rows.schema.field(k).type) for k, v in zip(keys, key, strict=False)}
        return pa.table(out | cells | {"own": pa.array(np.arange(len(at)) < len(own)), "part": named})

    kind = dict(voxels.dtypes)
    schema = f"object_id {kind['object_id']}, entity {kind['entity']}, z int, y int, x int, own boolean, part struct<z: int, y: int, x: int>"
    return spread(bricked(voxels.select(*keys, "z", "y", "x"), side), *keys, *names).groupBy(*keys, *names).applyInArrow(run, schema)


def gaps(voxels: DataFrame, spacing: Sequence[float], reach: float, side: int = SIDE) -> DataFrame:
    """(object_id, entity, label_a, label_b, gap_um): pairs of instances whose nearest voxel centres lie within ``reach``, label_a < label_b.

    Each brick compares its own voxels with those at all offsets within reach; the cost is
    voxels times offsets, whatever the number of instances.
    """
    halo = [math.floor(reach / s + 1e-9) for s in spacing]
    steps = [o for o in product(*[range(-h, h + 1) for h in halo]) if o > (0, 0, 0)]
    steps = sorted((math.sqrt(sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True))), o) for o in steps)
    steps = [(length, o) for length, o in steps if length <= reach]
    keys = ["object_id", "entity"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        brick = Brick(np.stack([rows[a].to_numpy() for a in "zyx"], 1).astype(np.int64), [k.as_py() for k in key[2:]], side, halo)
        found, code = np.unique(rows["label"].to_numpy(), return_inverse=True)
        dense = brick.field(code, -1)
        at, mine = brick.flat[brick.own], code[brick.own]
        least: dict[int, float] = {}
        for length, o in steps if len(found) > 1 else []:  # the shortest offset that joins a pair is its gap
            other = dense[at + brick.step(o)]
            meets = (other >= 0) & (other != mine)
            low, high = np.minimum(mine[meets], other[meets]), np.maximum(mine[meets], other[meets])
            for pair in np.unique(low * len(found) + high).tolist():
                least.setdefault(pair, length)
        a, b = np.divmod(np.array(list(least), np.int64), len(found))
        kind = rows.schema.field("label").type
        out = {k: pa.array([v] * len(a), rows.schema.field(k).type) for k, v in zip(keys, key, strict=False)}
        return pa.table(out | {"label_a": pa.array(found[a], kind), "label_b": pa.array(found[b], kind), "gap_um": pa.array(list(least.values()), pa.float64())})

    kind = dict(voxels.dtypes)
    schema = f"object_id {kind['object_id']}, entity {kind['entity']}, label_a {kind['label']}, label_b {kind['label']}, gap_um double"
    rows = bricked(voxels.select(*keys, "label", "z", "y", "x"), side, halo=halo)
    local = spread(rows, *keys, "bz", "by", "bx").groupBy(*keys, "bz", "by", "bx").applyInArrow(run, schema)
    return local.groupBy(*keys, "label_a", "label_b").agg(F.min("gap_um").alias("gap_um"))
