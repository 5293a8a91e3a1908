"""Quantised geometry payloads and surfaces of instances, as numpy kernels in Arrow groups."""

from __future__ import annotations

import struct
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.storage import spread, unsent
from granula.operators import morphology
from granula.operators.distance import lower_envelope

#: Instances with fewer voxels have no mesh.
LEAST_VOXELS = 8


def encode_mesh(vertices: np.ndarray, indices: np.ndarray) -> bytes:
    """Counts, least corner and extent of (x, y, z) vertices, then these as u16 fractions of the extent and indices as u16 or, from 65536 vertices on, u32."""
    low = (vertices.min(axis=0) if len(vertices) else np.zeros(3)).astype("<f4").astype(float)
    extent = (vertices.max(axis=0) - low if len(vertices) else np.zeros(3)).astype("<f4").astype(float)
    part = np.divide(vertices - low, extent, out=np.zeros((len(vertices), 3)), where=extent > 0)
    steps = np.rint(np.clip(part, 0, 1) * 65535).astype("<u2")
    head = struct.pack("<2I6f", len(vertices), indices.size, *low, *extent)
    return head + steps.tobytes() + indices.ravel().astype("<u2" if len(vertices) < 65536 else "<u4").tobytes()


def decode_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, *ends = struct.unpack_from("<2I6f", data)
    wide = np.dtype("<u2" if n < 65536 else "<u4")
    if len(data) != 32 + 6 * n + m * wide.itemsize:
        raise ValueError("the length of the payload does not match its header")
    steps = np.frombuffer(data, "<u2", 3 * n, 32).reshape(n, 3)
    return steps / 65535 * np.array(ends[3:]) + np.array(ends[:3]), np.frombuffer(data, wide, m, 32 + 6 * n).astype(np.int64)


def header_counts(data: bytes | None) -> tuple[int | None, int | None]:
    """Vertices and indices of a payload; null for one under eight bytes and for an ellipsoid."""
    return struct.unpack_from("<2I", data) if data is not None and len(data) >= 8 and len(data) != 60 else (None, None)


def drawable(radii: np.ndarray, stretch: float = 100.0) -> bool:
    """Whether radii are finite, positive and not collapsed: the greatest at most ``stretch`` times their mean."""
    radii = np.asarray(radii, float)
    return bool(np.isfinite(radii).all() and (radii > 0).all() and radii.max() / np.cbrt(radii.prod()) <= stretch)


def encode_ellipsoid(centre: np.ndarray, radii: np.ndarray, axes: np.ndarray) -> bytes | None:
    """Fifteen floats in x, y, z order: centre, radii, axes row by row; nothing for an ellipsoid that is not drawable."""
    if not drawable(radii) or not np.isfinite(centre).all() or not np.isfinite(axes).all():
        return None
    return struct.pack("<15f", *centre, *radii, *np.asarray(axes).ravel())


def decode_ellipsoid(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    v = np.array(struct.unpack("<15f", data))
    return (v[:3], v[3:6], v[6:].reshape(3, 3)) if drawable(v[3:6]) else None


def encode_tube(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray) -> bytes:
    return encode_mesh(vertices, edges) + radii.astype("<f4").tobytes()


def decode_tube(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    vertices, edges = decode_mesh(data[: len(data) - 4 * n])
    return vertices, edges.reshape(-1, 2), np.frombuffer(data, "<f4", n, len(data) - 4 * n)


def merged(parts: list[bytes]) -> bytes:
    """Several meshes as one; indices move by the vertices before them."""
    found = [decode_mesh(p) for p in parts]
    shift = np.cumsum([0, *[len(v) for v, _ in found]])
    return encode_mesh(np.vstack([v for v, _ in found]), np.concatenate([i + s for (_, i), s in zip(found, shift, strict=False)]))


def surface_net(mask: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles): one vertex in each cell of eight samples that the surface crosses, two triangles for each crossed edge, wound outwards."""
    m = np.pad(mask.astype(bool), 1)
    corner = np.stack([m[z : m.shape[0] - 1 + z, y : m.shape[1] - 1 + y, x : m.shape[2] - 1 + x] for z, y, x in product((0, 1), repeat=3)])
    crossed = corner.any(axis=0) & ~corner.all(axis=0)
    number = np.full(crossed.shape, -1)
    number[crossed] = np.arange(crossed.sum())
    # the vertex is the mean of the middles of the cell's crossed edges
    at, weight = np.zeros((*crossed.shape, 3)), np.zeros(crossed.shape)
    corners = list(product((0, 1), repeat=3))
    for i, a in enumerate(corners):
        for j, b in enumerate(corners[i + 1 :], i + 1):
            if sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1:
                on = corner[i] != corner[j]
                at += on[..., None] * (np.array(a) + np.array(b)) / 2
                weight += on
    vertices = (at[crossed] / weight[crossed][:, None] + np.argwhere(crossed) - 1) * np.array(spacing)
    # a table of crossed sample edges: the inner sample, the axis and the way out; four cells around an edge are its face
    samples, inner, way = np.argwhere(np.ones(m.shape, bool)), [], []
    flat = m.ravel()
    for axis in range(3):
        step = int(np.prod(m.shape[axis + 1 :]))
        first = np.flatnonzero(samples[:, axis] < m.shape[axis] - 1)
        for sign, at in ((1, first[flat[first] & ~flat[first + step]]), (-1, first[~flat[first] & flat[first + step]])):
            inner.append(samples[at])
            way.append(np.tile([axis, sign], (len(at), 1)))
    corner_of, (axis, sign) = np.concatenate(inner), np.concatenate(way).T
    rows = np.arange(len(axis))
    ring = []
    for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):  # around the axis, in the order of the two axes after it
        cell = corner_of.copy()
        cell[rows, (axis + 1) % 3] -= u
        cell[rows, (axis + 2) % 3] -= v
        ring.append(number[tuple(cell.T)])
    ring = np.stack(ring, 1)
    # seen from outside x, y, z order turns the other way round than z, y, x order
    ring = np.where(sign[:, None] > 0, ring[:, ::-1], ring)
    return vertices, np.concatenate([ring[:, [0, 1, 2]], ring[:, [0, 2, 3]]])


def edt(mask: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Distance of each voxel to the nearest one outside the mask, by lower envelopes; infinite without any."""
    out = np.where(mask, np.inf, 0.0)
    for axis, step in enumerate(spacing):
        at = np.arange(mask.shape[axis]) * step
        lines = np.moveaxis(out, axis, 0)
        out = np.moveaxis(lower_envelope(lines.reshape(len(at), -1), at, at).reshape(lines.shape), 0, axis)
    return np.sqrt(out)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian of ``sigma`` voxels along each axis, edges repeated."""
    reach = max(1, round(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    weight /= weight.sum()
    for axis in range(values.ndim if sigma > 0 else 0):
        wide = np.pad(values, [(reach, reach) if a == axis else (0, 0) for a in range(values.ndim)], mode="edge")
        values = sum(w * np.take(wide, range(k, k + values.shape[axis]), axis) for k, w in enumerate(weight))
    return values


#: The six tetrahedra of a cube around its diagonal: corners by the order in which the axes are walked.
_WALKS = [[(0, 0, 0), *[tuple(int(a in order[: k + 1]) for a in range(3)) for k in range(3)]] for order in permutations(range(3))]


def isosurface(field: np.ndarray, level: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(vertices in z, y, x samples, triangles) where ``field`` passes the level, each cube cut into tetrahedra.

    A vertex lies on a crossed edge by linear interpolation and is shared by all its
    triangles, so the surface is closed; triangles face the lower side in x, y, z order.
    """
    inside = field > level
    shape, base = np.array(field.shape), np.argwhere(np.ones(np.array(field.shape) - 1, bool))
    ends, faces = [], []
    for walk in _WALKS:
        corners = np.stack([np.ravel_multi_index(tuple((base + np.array(c)).T), field.shape) for c in walk], 1)
        state = inside.ravel()[corners]
        for n_in in (1, 2, 3):
            cut = corners[state.sum(axis=1) == n_in]
            if not len(cut):
                continue
            order = np.argsort(~inside.ravel()[cut], axis=1, kind="stable")
            c = np.take_along_axis(cut, order, 1)  # the inner corners first
            links = {1: [(0, 1), (0, 2), (0, 3)], 2: [(0, 2), (0, 3), (1, 3), (1, 2)], 3: [(0, 3), (1, 3), (2, 3)]}[n_in]
            loop = np.stack([np.stack([c[:, a], c[:, b]], 1) for a, b in links], 1)
            for tri in ([0, 1, 2], [0, 2, 3]) if n_in == 2 else ([0, 1, 2],):
                ends.append(loop[:, tri])
                faces.append((c[:, :n_in], c[:, n_in:]))
    if not ends:
        return np.zeros((0, 3)), np.zeros((0, 3), int)
    edges = np.sort(np.concatenate(ends), axis=2).reshape(-1, 2)
    pairs, index = np.unique(edges, axis=0, return_inverse=True)
    a, b = field.ravel()[pairs[:, 0]], field.ravel()[pairs[:, 1]]
    place = lambda k: np.stack(np.unravel_index(k, shape), -1).astype(float)
    t = (level - a) / (b - a)
    vertices = place(pairs[:, 0]) + t[:, None] * (place(pairs[:, 1]) - place(pairs[:, 0]))
    triangles = index.reshape(-1, 3)
    out = np.concatenate([place(o).mean(axis=1) - place(i).mean(axis=1) for i, o in faces])
    p, q, r = (vertices[triangles[:, k]] for k in range(3))
    turned = np.einsum("ij,ij->i", np.cross(q - p, r - p), out) > 0  # outwards in z, y, x order is inwards in x, y, z
    triangles[turned] = triangles[turned][:, ::-1]
    keep = (triangles[:, 0] != triangles[:, 1]) & (triangles[:, 1] != triangles[:, 2]) & (triangles[:, 0] != triangles[:, 2])
    return vertices, triangles[keep]


def instance_mesh(mask: np.ndarray, spacing=(1.0, 1.0, 1.0), method: str = "surface_nets", sigma: float = 1.0, step: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, y, z vertices in micrometres, triangles) of one instance, or nothing under LEAST_VOXELS voxels.

    ``isosurface``: the signed distance, smoothed; the smoothing stays below the radius of the
    largest ball inside and a step below half of it, so thin parts are not lost.
    """
    if mask.sum() < LEAST_VOXELS:
        return None
    if method == "surface_nets":
        vertices, faces = surface_net(mask, spacing)
        return vertices[:, ::-1], faces
    pad = max(2, 2 * step)
    wide = np.pad(mask, pad)
    inner, outer = edt(wide), edt(~wide)
    radius = inner.max()
    field = smoothed(np.where(wide, inner - 0.5, 0.5 - outer), min(sigma, 0.5 * radius))
    step = max(1, min(step, int(radius // 2)))
    vertices, faces = isosurface(field[::step, ::step, ::step])
    return ((vertices * step - pad) * np.array(spacing))[:, ::-1], faces


def surfaces(voxels: DataFrame, spacing=(1.0, 1.0, 1.0), method: str = "surface_nets", sigma: float = 1.0, step: int = 1) -> DataFrame:
    """(object_id, entity, label, surface, surface_vertices, surface_elements) of spatial instances, each in its own box; an instance without a mesh has nulls."""
    keys = ["object_id", "entity", "label"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        zyx = np.stack([rows[a].to_numpy() for a in "zyx"], 1)
        low = zyx.min(axis=0)
        mask = np.zeros(zyx.max(axis=0) - low + 1, bool)
        mask[tuple((zyx - low).T)] = True
        made = instance_mesh(mask, spacing, method, sigma, step)
        shift = (low * np.array(spacing))[::-1]
        found = (None, None, None) if made is None else (encode_mesh(made[0] + shift, made[1]), len(made[0]), len(made[1]))
        out = {k: pa.array([v.as_py()], rows.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        return pa.table(out | {"surface": pa.array([found[0]], pa.binary()), "surface_vertices": pa.array([found[1]], pa.int32()), "surface_elements": pa.array([found[2]], pa.int32())})

    kinds = ", ".join(f"{k} {dict(voxels.dtypes)[k]}" for k in keys)
    return spread(voxels, *keys).groupBy(*keys).applyInArrow(run, f"{kinds}, surface binary, surface_vertices int, surface_elements int")


def outlines(voxels: DataFrame, spacing=(1.0, 1.0)) -> DataFrame:
    """(object_id, entity, label, outline, outline_points) of planar instances: closed loops at half way, holes too, as line payloads with z = 0."""
    from granula.operators import volumes

    keys = ["object_id", "entity", "label"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        yx = np.stack([rows[a].to_numpy() for a in "yx"], 1)
        low = yx.min(axis=0)
        mask = np.zeros(yx.max(axis=0) - low + 1, bool)
        mask[tuple((yx - low).T)] = True
        loops = [loop + low * np.array(spacing) for loop in volumes.outlines(mask, spacing)]
        points = np.concatenate(loops)
        first = np.cumsum([0, *map(len, loops)])
        lines = np.concatenate([np.stack([np.arange(a, b), np.roll(np.arange(a, b), -1)], 1) for a, b in zip(first, first[1:], strict=False)])
        payload = encode_mesh(np.column_stack([points[:, 1], points[:, 0], np.zeros(len(points))]), lines)
        out = {k: pa.array([v.as_py()], rows.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        return pa.table(out | {"outline": pa.array([payload], pa.binary()), "outline_points": pa.array([len(points)], pa.int32())})

    kinds = ", ".join(f"{k} {dict(voxels.dtypes)[k]}" for k in keys)
    return spread(voxels, *keys).groupBy(*keys).applyInArrow(run, f"{kinds}, outline binary, outline_points int")


def ellipsoids(found: DataFrame) -> DataFrame:
    """``found`` (of equivalent_ellipsoids()) as (object_id, entity, label, surface): null where the ellipsoid is not drawable."""

    def run(batches):
        for batch in batches:
            rows = [np.array([v if v is not None else np.nan for v in batch.column(c).to_pylist()], float) for c in ("x_um", "y_um", "z_um")]
            centres = np.stack(rows, 1)
            made = [encode_ellipsoid(c, np.array(d) / 2, np.array(x).reshape(3, 3)) for c, d, x in zip(centres, batch.column("diameters").to_pylist(), batch.column("axes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("object_id", "entity", "label")], pa.array(made, pa.binary())], ["object_id", "entity", "label", "surface"])

    kinds = dict(found.dtypes)
    return found.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in ("object_id", "entity", "label")), "surface binary"]))


def geometry_rows(voxels: DataFrame, kinds: DataFrame, spacing, metrics: DataFrame, contacts: DataFrame | None = None, choice: str = "auto", method: str = "surface_nets", centre: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """The geometry table: a row for each instance, for each whole mask (row_type file) and for each contact.

    ``kinds``: (object_id, entity, entity_kind); ``metrics``: by object_id, entity, label with
    volume_um3, surface_area_um2, sphericity and aspect_ratio_major_minor. ``choice`` is mesh,
    ellipsoid or auto (by shape). Metrics and the choice are joins; payloads are made only
    for the rows that need them. ``centre`` (object_id, cz, cy, cx) adds each row's direction
    from it, null where a part is missing; ``lines`` (of skeletons()) adds measures and
    payloads of centre lines, which instances without one lack.
    """
    keys = ["object_id", "entity", "label"]
    kind = F.when(F.col("entity_kind") == "label", "instance").otherwise("file")
    rows = metrics.join(unsent(kinds), ["object_id", "entity"]).withColumn("row_type", kind)
    boxes = morphology.bounding_boxes(voxels).select(*keys, "n", "fill_ratio")
    wanted = scalar.surface_choice(F.col("aspect_ratio_major_minor"), F.col("sphericity"), F.lit(0), F.lit(False)) if choice == "auto" else F.lit(choice)
    rows = rows.join(unsent(boxes), keys, "left").withColumn("surface_kind", F.when(F.col("row_type") == "file", "mesh").otherwise(wanted))
    round_ones = voxels.join(unsent(rows.where("surface_kind = 'ellipsoid'").select(*keys)), keys, "left_semi")
    drawn = ellipsoids(morphology.equivalent_ellipsoids(round_ones, spacing)).withColumns({"surface_vertices": F.lit(None).cast("int"), "surface_elements": F.lit(None).cast("int")})
    meshed = surfaces(voxels.join(unsent(rows.where("surface_kind = 'mesh'").select(*keys)), keys, "left_semi"), spacing, method)
    rows, more = rows.join(unsent(drawn.unionByName(meshed)), keys, "left"), []
    if centre is not None:
        places = morphology.centroids(voxels, spacing).join(unsent(centre), "object_id", "left")
        found = scalar.direction(*[F.col(f"{a}_um") - F.col(f"c{a}") for a in "zyx"])
        rows = rows.join(unsent(places.select(*keys, *[c.alias(n) for n, c in found.items()])), keys, "left")
        more += list(found)
    if lines is not None:
        rows = rows.join(unsent(lines.select(*keys, "skeleton", *[F.col(f"instance_{n}").alias(n) for n in ("branches", "length_um", "tortuosity")])), keys, "left")
        more += ["skeleton", "branches", "length_um", "tortuosity"]
    out = rows.select(
        "object_id", "row_type", F.col("entity").alias("entity_name"), F.when(F.col("row_type") == "instance", F.col("label").cast("long")).alias("label"), F.col("n").alias("voxels"),
        "volume_um3", "surface_area_um2", "sphericity", "aspect_ratio_major_minor", "fill_ratio", F.when(F.col("surface").isNotNull(), F.col("surface_kind")).alias("surface_kind"),
        "surface", "surface_vertices", "surface_elements", *more,
    )
    if contacts is None:
        return out
    pairs = contacts.select("object_id", F.lit("contact").alias("row_type"), F.col("entity").alias("entity_a"), F.col("label_a").cast("long"), F.col("entity").alias("entity_b"), F.col("label_b").cast("long"), "gap_um")
    return out.unionByName(pairs, allowMissingColumns=True)


def write_geometry(rows: DataFrame, path: str) -> None:
    """Geometry as Parquet by object; empty payloads are null."""
    for c in ("surface", "outline", "skeleton"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(F.octet_length(c) > 0, F.col(c)))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("object_id").parquet(path)


def reusable(rows: DataFrame, fingerprint: str) -> bool:
    """Whether a stored geometry has rows and was made with the same settings."""
    return "fingerprint" in rows.columns and not rows.isEmpty() and rows.where((F.col("fingerprint") != fingerprint) | F.col("fingerprint").isNull()).isEmpty()
