"""Dilation of voxel tables, and kernels on dense masks: growing, components, distances, thinned planes and outlines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from granula.operators.graph import neighbour_offsets


def dilated(voxels: DataFrame, rounds: int = 1) -> DataFrame:
    """Voxels (object_id, entity, z, y, x) grown by their 26 neighbours, in bricks with a layer of ``rounds`` voxels."""
    from granula.operators.flood import brick_dilated

    return brick_dilated(voxels, rounds)


def shifted_any(mask: np.ndarray, offsets: list[tuple[int, ...]]) -> np.ndarray:
    """Whether a voxel or any of its neighbours at ``offsets`` is set."""
    out = mask.copy()
    padded = np.pad(mask, 1)
    for o in offsets:
        out |= padded[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape, strict=True))]
    return out


def grown(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        mask = shifted_any(mask, neighbour_offsets(mask.ndim))
    return mask


def labelled(mask: np.ndarray, full: bool = True) -> np.ndarray:
    """Component numbers 1, 2, ... in scan order; 0 outside."""
    out, n = np.zeros(mask.shape, np.int64), 0
    offsets = neighbour_offsets(mask.ndim, full)
    for start in map(tuple, np.argwhere(mask)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            at = todo.pop()
            for o in offsets:
                q = tuple(a + d for a, d in zip(at, o, strict=True))
                if all(0 <= a < s for a, s in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


def squared_distance(mask: np.ndarray, spacing: tuple[float, ...]) -> np.ndarray:
    """Squared distance of each voxel to the nearest one outside the mask, exact, axis by axis; infinite without any."""
    out = np.where(mask, np.inf, 0.0)
    for axis, step in enumerate(spacing):
        n = mask.shape[axis]
        cost = ((np.arange(n)[:, None] - np.arange(n)[None, :]) * step) ** 2
        lines = np.moveaxis(out, axis, -1)
        out = np.moveaxis(np.min(lines[..., None, :] + cost, axis=-1), -1, axis)
    return out


def thinned(mask: np.ndarray) -> np.ndarray:
    """One-pixel centre lines of a plane by alternating parallel passes that keep connectivity."""
    m = np.pad(mask.astype(bool), 1)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = m.sum()
        for turn in (0, 1):
            p = [np.roll(m, (-dy, -dx), (0, 1)) for dy, dx in ring]
            count = sum(q.astype(int) for q in p)
            rises = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            open_ = ~(north & east & south) & ~(east & south & west) if turn == 0 else ~(north & east & west) & ~(north & south & west)
            m = m & ~(m & (count >= 2) & (count <= 6) & (rises == 1) & open_)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def outlines(mask: np.ndarray, spacing: tuple[float, float] = (1.0, 1.0)) -> list[np.ndarray]:
    """Closed loops (y, x) half way between inside and outside pixels, holes included; the inside lies on one hand throughout."""
    m = np.pad(mask.astype(bool), 1)
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    # middles of the cell sides by corner code (top-left, top-right, bottom-right, bottom-left)
    side = {"t": (0.0, 0.5), "r": (0.5, 1.0), "b": (1.0, 0.5), "l": (0.5, 0.0)}
    runs = {1: "lt", 2: "tr", 3: "lr", 4: "rb", 5: "lt rb", 6: "tb", 7: "lb", 8: "bl", 9: "bt", 10: "tr bl", 11: "br", 12: "rl", 13: "rt", 14: "tl"}
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]
    for y, x in np.argwhere((code > 0) & (code < 15)).tolist():
        for a, b in runs[int(code[y, x])].split() if " " in runs[int(code[y, x])] else [runs[int(code[y, x])]]:
            start, end = ((y + side[s][0] - 0.5, x + side[s][1] - 0.5) for s in (a, b))
            after.setdefault((start[0] - 0.5, start[1] - 0.5), []).append((end[0] - 0.5, end[1] - 0.5))
    out = []
    while after:
        first = at = next(iter(after))
        loop = []
        while True:
            loop.append(at)
            nexts = after[at]
            to = nexts.pop()
            if not nexts:
                del after[at]
            at = to
            if at == first:
                break
        out.append(np.array(loop) * np.array(spacing))
    return out
