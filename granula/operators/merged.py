"""One mesh payload for each structure of a scene, put together from those of its instances.

Every instance's piece depends on three things from the others: the box of all, the vertices before
it and the indices before it. Boxes are an aggregate, the others running sums over ranges of
labels. Each piece is then worked out by itself, with the byte it begins at, so a
structure of any number of instances is dealt over all tasks and its payload can be written
in parallel or one after the other.

Defined results: rows without a surface add nothing; null keys are keys of their own; repeated
instances come repeatedly, in any order among themselves; an empty table gives an empty
result; a payload that does not match its header is an error; other columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.prefix import running_sums
from granula.functions.storage import stored
from granula.operators.geometry import decode_mesh

HEAD = 32
#: Payloads up to so many bytes are put together in one row.
MOST_BYTES = 1 << 30


def _headers(rows: DataFrame) -> DataFrame:
    """``rows`` (object_id, entity_name, label, surface) with n, m and the ends of each piece's box."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(3).to_pylist():
                points, faces = decode_mesh(data)
                # the ends of the points and not of the header, whose box is rounded
                ends = [*points.min(axis=0), *points.max(axis=0)] if len(points) else [None] * 6
                found.append((len(points), len(faces), *(None if v is None else float(v) for v in ends)))
            cols = list(zip(*found, strict=True)) or [()] * 8
            ends = [pa.array(c, pa.float64()) for c in cols[2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *ends], [*batch.schema.names, "n", "m", *(f"{e}{a}" for e in ("low", "high") for a in "xyz")])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), "n long, m long", *(f"{e}{a} double" for e in ("low", "high") for a in "xyz")])
    return rows.mapInArrow(run, schema)


def scene_parts(rows: DataFrame, name: str = "scene") -> DataFrame:
    """(object_id, entity_name, offset, bytes): the payload of each structure in parts, each with its place; ``rows`` as of a geometry table."""
    keys = ["object_id", "entity_name"]
    pieces = _headers(rows.select(*keys, F.col("label").cast("long").alias("label"), "surface").where("surface is not null and octet_length(surface) > 0"))
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), f"{name}-pieces")
    place = F.struct(F.col("label").isNull(), F.coalesce("label", F.lit(0)), "row")  # repeated labels stay apart
    order = pieces.select(*keys, "row", place.alias("place"), "n", "m")
    before = running_sums(order, keys, "place", "n", f"{name}-vertices").select("row", F.col("below").alias("vertices"), F.col("total").alias("all_n"))
    index = running_sums(order, keys, "place", "m", f"{name}-indices").select("row", F.col("below").alias("indices"), F.col("total").alias("all_m"))
    ends = pieces.groupBy(*keys).agg(*[f(f"{e}{a}").alias(f"all_{e}{a}") for e, f in (("low", F.min), ("high", F.max)) for a in "xyz"])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    ends = ends.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = pieces.select(*keys, "row", "surface").join(before, "row").join(index, "row").join(ends, same[0] & same[1]).drop(*[f"__{k}" for k in keys])
    kinds, box = dict(met.dtypes), [f"all_{e}{a}" for e in ("low", "high") for a in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = [batch.column(c).to_pylist() for c in ("surface", "vertices", "all_n", "indices", "all_m", *box)]
            for k, (data, vertices, all_n, indices, all_m, *sides) in enumerate(zip(*at, strict=True)):
                ends = np.array([0.0 if v is None else v for v in sides])  # no piece has a vertex
                low = ends[:3].astype("<f4").astype(float)
                extent = (ends[3:] - low).astype("<f4").astype(float)
                points, faces = decode_mesh(data)
                part = np.divide(points - low, extent, out=np.zeros((len(points), 3)), where=extent > 0)
                wide = np.dtype("<u2" if all_n < 65536 else "<u4")
                if vertices == 0 and indices == 0:  # the first piece that has vertices brings the header
                    out.append((k, 0, struct.pack("<2I6f", all_n, all_m, *low, *extent)))
                out.append((k, HEAD + 6 * vertices, np.rint(np.clip(part, 0, 1) * 65535).astype("<u2").tobytes()))
                out.append((k, HEAD + 6 * all_n + wide.itemsize * indices, (faces + vertices).astype(wide).tobytes()))
            where = pa.array([k for k, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array([o for _, o, _ in out], pa.int64()), pa.array([b for _, _, b in out], pa.binary())], [*keys, "offset", "bytes"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "offset long, bytes binary"])
    found = met.select(*keys, "surface", "vertices", "all_n", "indices", "all_m", *box).mapInArrow(run, schema)
    # pieces without vertices before the first that has some bring the same header again
    return found.where(F.octet_length("bytes") > 0).groupBy(*keys, "offset").agg(F.max("bytes").alias("bytes"))


def scene_payloads(parts: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(object_id, entity_name, n_bytes, surface): the parts in order as one payload, null where it would have more than ``most`` bytes; those are read by parts."""
    keys = ["object_id", "entity_name"]
    sized = stored(parts.groupBy(*keys).agg(F.sum(F.octet_length("bytes")).cast("long").alias("n_bytes")), "scene-sizes")
    same = F.col("object_id").eqNullSafe(F.col("__o")) & F.col("entity_name").eqNullSafe(F.col("__e"))
    few = sized.where(F.col("n_bytes") <= most).select(F.col("object_id").alias("__o"), F.col("entity_name").alias("__e"))
    own = parts.join(few, same, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("offset", "bytes"))).alias("p"))  # ``most`` bytes at most
    whole = own.select(F.col("object_id").alias("__o"), F.col("entity_name").alias("__e"), F.aggregate(F.transform("p", lambda x: x["bytes"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("surface"))
    return sized.join(whole, same, "left").select(*keys, "n_bytes", "surface")
