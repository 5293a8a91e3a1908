"""Chunked arrays (Zarr v2 and N5) below a local or shared folder: one row, and so one unit of work, for each chunk."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes are big-endian in N5; its types by name.
_N5 = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "float32": "f4", "float64": "f8"}


def array_info(path: str) -> dict:
    """Shape and chunk shape in z, y, x order, type, compression and form of an array."""
    folder = Path(path)
    if (folder / ".zarray").exists():
        said = json.loads((folder / ".zarray").read_text())
        packed = (said.get("compressor") or {}).get("id", "raw")
        if said.get("order", "C") != "C" or said.get("filters"):
            raise ValueError(f"{path}: order or filters are not supported")
        return {"form": "zarr", "shape": said["shape"], "chunks": said["chunks"], "dtype": said["dtype"], "packed": packed, "sep": said.get("dimension_separator", "."), "fill": said.get("fill_value") or 0}
    if (folder / "attributes.json").exists() and "dimensions" in (said := json.loads((folder / "attributes.json").read_text())):
        packed = (said.get("compression") or {}).get("type", "raw")
        return {"form": "n5", "shape": said["dimensions"][::-1], "chunks": said["blockSize"][::-1], "dtype": ">" + _N5[said["dataType"]], "packed": packed, "sep": "/", "fill": 0}
    raise ValueError(f"{path}: neither a Zarr nor an N5 array")


def _unpacked(data: bytes, packed: str) -> bytes:
    if packed == "raw":
        return data
    if packed == "gzip":
        return gzip.decompress(data)
    if packed in ("zlib", "deflate"):
        return zlib.decompress(data)
    if packed == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {packed} is not supported")


def read_chunk(path: str, info: dict, place: tuple[int, ...]) -> np.ndarray | None:
    """The samples of one chunk within the array, or nothing for a chunk that was never written."""
    names = place if info["form"] == "zarr" else place[::-1]
    file = Path(path) / info["sep"].join(map(str, names))
    if not file.exists():
        return None
    data, shape = file.read_bytes(), tuple(info["chunks"])
    if info["form"] == "n5":
        mode, dims = struct.unpack_from(">2H", data)
        shape = struct.unpack_from(f">{dims}I", data, 4)[::-1]
        data = data[4 + 4 * dims + 4 * (mode == 1) :]
    found = np.frombuffer(_unpacked(data, info["packed"]), info["dtype"], int(np.prod(shape))).reshape(shape)
    return found[tuple(slice(0, max(0, s - c * p)) for s, c, p in zip(info["shape"], info["chunks"], place, strict=True))]


def voxels(spark: SparkSession, path: str, box: list[tuple[int | None, int | None]] | None = None) -> DataFrame:
    """(z, y, x, label) of the samples that are not 0, each task some chunks; a crop box leaves out the chunks it does not meet."""
    info = array_info(path)
    if len(info["shape"]) not in (2, 3):
        raise ValueError(f"{path}: {len(info['shape'])} dimensions")
    ends = [(lo or 0, s if hi is None else min(hi, s)) for (lo, hi), s in zip(box or [(None, None)] * len(info["shape"]), info["shape"], strict=True)]
    ranges = [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(ends, info["chunks"], strict=True)]
    places = [(",".join(map(str, p)),) for p in product(*ranges)]  # names of chunks, not their samples
    rows = spark.createDataFrame(places, "place string").repartition(min(len(places), 8 * spark.sparkContext.defaultParallelism) or 1)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for text in pdf["place"]:
                place = tuple(map(int, text.split(",")))
                found = read_chunk(path, info, place)
                if found is None:
                    continue
                at = np.argwhere(found)
                index = at + np.array(place) * np.array(info["chunks"])
                keep = np.all([(index[:, k] >= lo) & (index[:, k] < hi) for k, (lo, hi) in enumerate(ends)], axis=0)
                index = index[keep] - np.array([lo for lo, _ in ends])
                z = index[:, 0] if index.shape[1] == 3 else np.zeros(len(index), int)
                yield pd.DataFrame({"z": z.astype(np.int32), "y": index[:, -2].astype(np.int32), "x": index[:, -1].astype(np.int32), "label": found[tuple(at[keep].T)].astype(np.int64)})

    return rows.mapInPandas(run, "z int, y int, x int, label long")


def voxel_size_um(store: str, array: str) -> tuple[float, ...] | None:
    """The voxel size that a store gives an array: the scale of ``multiscales``, else ``pixelResolution`` reversed, both in nanometres unless a unit says micrometres."""
    folder = Path(store) / array
    for place in (folder, folder.parent):
        for name in (".zattrs", "attributes.json"):
            said = json.loads((place / name).read_text()) if (place / name).exists() else {}
            for scales in said.get("multiscales", []):
                unit = {a.get("unit") for a in scales.get("axes", []) if isinstance(a, dict)} - {None}
                for data in scales.get("datasets", []):
                    if data.get("path") in (folder.name, "") or place == folder:
                        scale = next((t["scale"] for t in data.get("coordinateTransformations", []) if t.get("type") == "scale"), (data.get("transform") or {}).get("scale"))
                        if scale:
                            return tuple(float(v) / (1 if unit & {"micrometer", "um", "µm"} else 1000) for v in scale[-3:])
            size = said.get("pixelResolution")
            if size:
                found = size["dimensions"] if isinstance(size, dict) else size
                micro = isinstance(size, dict) and size.get("unit") in ("um", "µm", "micrometer")
                return tuple(float(v) / (1 if micro else 1000) for v in found[::-1])
    return None
