"""Image volumes as rows: TIFF, NIfTI-1 and NRRD files through the binary file source.

Files are read whole by one task each and parsed with numpy; voxels come out as the sparse
table (path, z, y, x, label). Headers alone give shape, type and voxel size in micrometres.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known endings, the longest first.
SUFFIXES = (".nii.gz", ".nrrd", ".tiff", ".mha", ".mgh", ".mgz", ".nii", ".tif")
_TIFF_KIND = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d", 16: "Q"}
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_NRRD = {
    "uchar": "u1", "uint8": "u1", "unsigned char": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "ulonglong": "u8", "uint64": "u8", "float": "f4", "double": "f8",
}


@dataclass(frozen=True)
class Header:
    """Shape and spacing run z, y, x (or y, x); spacing is None where the file has none."""

    shape: tuple[int, ...]
    dtype: str
    spacing_um: tuple[float, ...] | None


def image_suffix(name: str) -> str:
    low = name.lower()
    return next((s for s in SUFFIXES if low.endswith(s)), "")


def _tiff_pages(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    pages, at = [], struct.unpack_from(order + "I", data, 4)[0]
    while at:
        tags = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code = _TIFF_KIND.get(kind)
            if code is None:
                continue
            fmt = f"{order}{count}s" if code == "s" else order + code * count
            size = struct.calcsize(fmt)
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(fmt, data, where)
        pages.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return order, pages


def _tiff_header(data: bytes) -> tuple[Header, str, list[dict[int, tuple]]]:
    order, pages = _tiff_pages(data)
    first = pages[0]
    bits, form = first.get(258, (1,))[0], first.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    text = first.get(270, (b"",))[0].decode("latin-1")
    said = dict(re.findall(r"(\w+)=([^\n\0]+)", text)) if text.startswith("ImageJ") else {}
    depth = max(len(pages), int(said.get("images", said.get("slices", 1))))
    plane = (first[257][0], first[256][0])
    shape = plane if depth == 1 else (depth, *plane)
    spacing = None
    if 282 in first and 283 in first:
        (xn, xd), (yn, yd) = first[282], first[283]
        unit = {2: 25400.0, 3: 10000.0}.get(first.get(296, (1,))[0], 1.0)
        if xn and yn:
            flat = (unit * yd / yn, unit * xd / xn)
            spacing = flat if len(shape) == 2 else (float(said["spacing"]), *flat) if "spacing" in said else None
    return Header(shape, dtype.str, spacing), order, pages


def _unpack_bits(data: bytes) -> bytes:
    """Runs: n + 1 bytes as they are, or one byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the high bit first; 256 empties the table, 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = held = at = 0
    width = 9
    while True:
        while held < width:
            if at == len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 + sum(len(table) + 1 >= 1 << n for n in (9, 10, 11))


#: TIFF compressions: none, LZW, deflate (two numbers), PackBits.
_UNPACK = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}


def _unpredicted(raw: bytes, page: dict, dtype: np.dtype, shape: tuple[int, int]) -> bytes:
    """Rows whose samples are differences to the one before (predictor 2) added up."""
    if page.get(317, (1,))[0] != 2:
        return raw
    rows = np.frombuffer(raw, dtype, shape[0] * shape[1]).reshape(shape)
    return np.cumsum(rows, axis=1, dtype=rows.dtype).astype(dtype).tobytes()


def read_tiff(data: bytes) -> np.ndarray:
    """Uncompressed and deflate strips; a contiguous stack may follow its first page."""
    head, _, pages = _tiff_header(data)
    dtype, planes = np.dtype(head.dtype), []
    count = head.shape[0] if len(head.shape) == 3 else 1
    plane = int(np.prod(head.shape[-2:])) * dtype.itemsize
    for page in pages:
        packed = page.get(259, (1,))[0]
        tiled = 324 in page
        strips = [data[o : o + n] for o, n in zip(page[324 if tiled else 273], page[325 if tiled else 279], strict=True)]
        if packed not in _UNPACK:
            raise ValueError(f"TIFF compression {packed} is not supported")
        strips = [_UNPACK[packed](s) for s in strips]
        if not tiled:
            planes.append(_unpredicted(b"".join(strips)[:plane], page, dtype, head.shape[-2:]))
            continue
        high, wide = head.shape[-2:]
        th, tw = page[323][0], page[322][0]
        full = np.zeros((-(-high // th) * th, -(-wide // tw) * tw), dtype)
        across = full.shape[1] // tw
        for k, raw in enumerate(strips):
            y, x = k // across * th, k % across * tw
            full[y : y + th, x : x + tw] = np.frombuffer(_unpredicted(raw, page, dtype, (th, tw)), dtype, th * tw).reshape(th, tw)
        planes.append(full[:high, :wide].tobytes())
    if len(pages) == 1 and count > 1:
        at = pages[0][273][0]
        planes = [data[at : at + plane * count]]
    return np.frombuffer(b"".join(planes), dtype).reshape(head.shape)


def write_tiff(pixels: np.ndarray, spacing_um: tuple[float, ...] | None = None) -> bytes:
    """A classic little-endian TIFF with one uncompressed page per plane and the spacing in its description."""
    stack = pixels if pixels.ndim == 3 else pixels[None]
    stack = stack.astype(stack.dtype.newbyteorder("<"))
    form = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    text = f"ImageJ=1.11a\nimages={len(stack)}\nslices={len(stack)}\n" + (f"spacing={spacing_um[0]}\n" if spacing_um and len(spacing_um) == 3 else "")
    note = text.encode() + b"\0"
    ratio = [(1_000_000, round(s * 1_000_000)) for s in (spacing_um or (1.0, 1.0))[-2:]]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for plane in stack:
        raw = plane.tobytes()
        at = len(out)
        out += raw
        notes = len(out)
        out += note + struct.pack("<4I", *ratio[1], *ratio[0]) + b"\0" * (len(note) % 2)
        rows = [
            (256, 4, 1, plane.shape[1]), (257, 4, 1, plane.shape[0]), (258, 3, 1, stack.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(note), notes),
            (273, 4, 1, at), (277, 3, 1, 1), (278, 4, 1, plane.shape[0]), (279, 4, 1, len(raw)), (282, 5, 1, notes + len(note)), (283, 5, 1, notes + len(note) + 8), (296, 3, 1, 1), (339, 3, 1, form),
        ]
        if len(out) % 2:
            out += b"\0"
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _nifti_header(data: bytes) -> tuple[Header, int]:
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dims = struct.unpack_from(order + "8h", data, 40)
    (code,) = struct.unpack_from(order + "h", data, 70)
    size = struct.unpack_from(order + "8f", data, 76)
    (offset,) = struct.unpack_from(order + "f", data, 108)
    n = min(3, dims[0])
    shape, spacing = dims[n:0:-1], tuple(float(s) * 1000 for s in size[n:0:-1])
    if n == 3 and shape[0] == 1:  # one slice is a plane
        shape, spacing = shape[1:], spacing[1:]
    if any(s <= 0 for s in spacing):
        raise ValueError("a voxel size is not positive")
    return Header(tuple(shape), np.dtype(order + _NIFTI.get(code, "f8")).str, spacing), int(offset)


def _nrrd_header(data: bytes) -> tuple[Header, str, int]:
    end = data.index(b"\n\n") + 2
    said = dict(line.split(": ", 1) for line in data[:end].decode("latin-1").splitlines() if ": " in line and not line.startswith("#"))
    shape = tuple(map(int, said["sizes"].split()))[::-1]
    order = ">" if said.get("endian") == "big" else "<"
    if "space directions" in said:
        size = [float(np.linalg.norm([float(v) for v in g.split(",")])) for g in re.findall(r"\(([^)]*)\)", said["space directions"])]
    else:
        size = [float(s) for s in said["spacings"].split()] if "spacings" in said else None
    spacing = tuple(s * 1000 for s in size[::-1]) if size else None
    return Header(shape, np.dtype(order + _NRRD.get(said["type"], "f8")).str, spacing), said.get("encoding", "raw"), end


_META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_ULONG_LONG": "u8", "MET_LONG_LONG": "i8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
_MGH = {0: "u1", 1: "i4", 3: "f4", 4: "i2"}


def _squeezed(shape: tuple[int, ...], spacing: tuple[float, ...] | None) -> tuple[tuple[int, ...], tuple[float, ...] | None]:
    """One slice is a plane; a spacing that is not positive is an error."""
    if spacing and any(not s > 0 for s in spacing):
        raise ValueError("a voxel size is not positive")
    return (shape[1:], spacing and spacing[1:]) if len(shape) == 3 and shape[0] == 1 else (shape, spacing)


def _mha_header(data: bytes) -> tuple[Header, bool, int]:
    end = data.index(b"\n", data.index(b"ElementDataFile")) + 1
    said = dict(line.split(" = ", 1) for line in data[:end].decode("latin-1").splitlines() if " = " in line)
    if said["ElementDataFile"].strip() != "LOCAL":
        raise ValueError("pixels in another file are not supported")
    shape = tuple(map(int, said["DimSize"].split()))[::-1]
    size = said.get("ElementSpacing") or said.get("ElementSize")
    shape, spacing = _squeezed(shape, tuple(float(v) * 1000 for v in size.split())[::-1] if size else None)
    big = said.get("BinaryDataByteOrderMSB", said.get("ElementByteOrderMSB", "False")).strip().lower() == "true"
    return Header(shape, np.dtype((">" if big else "<") + _META.get(said["ElementType"].strip(), "f8")).str, spacing), said.get("CompressedData", "False").strip().lower() == "true", end


def _mgh_header(data: bytes) -> Header:
    _, w, h, d, _, kind, _, good = struct.unpack_from(">7iH", data)
    size = struct.unpack_from(">3f", data, 30) if good else (1.0, 1.0, 1.0)
    shape, spacing = _squeezed((d, h, w), tuple(float(s) * 1000 for s in size[::-1]))
    return Header(shape, np.dtype(">" + _MGH.get(kind, "f8")).str, spacing)


def read_header(name: str, data: bytes) -> Header:
    kind = image_suffix(name)
    if kind == ".mha":
        return _mha_header(data)[0]
    if kind in (".mgh", ".mgz"):
        return _mgh_header(gunzipped(data) if kind == ".mgz" else data)
    if kind in (".tif", ".tiff"):
        return _tiff_header(data)[0]
    if kind in (".nii", ".nii.gz"):
        return _nifti_header(gunzipped(data) if kind.endswith("gz") else data)[0]
    if kind == ".nrrd":
        return _nrrd_header(data)[0]
    raise ValueError(f"{name}: no known image format")


def gunzipped(data: bytes) -> bytes:
    """The bytes of a gzip file, as far as they go: a file may be cut off after its header."""
    return zlib.decompressobj(31).decompress(data)


def read_volume(name: str, data: bytes) -> np.ndarray:
    kind = image_suffix(name)
    if kind == ".mha":
        head, packed, at = _mha_header(data)
        return np.frombuffer(zlib.decompress(data[at:]) if packed else data, head.dtype, int(np.prod(head.shape)), 0 if packed else at).reshape(head.shape)
    if kind in (".mgh", ".mgz"):
        raw = gzip.decompress(data) if kind == ".mgz" else data
        head = _mgh_header(raw)
        return np.frombuffer(raw, head.dtype, int(np.prod(head.shape)), 284).reshape(head.shape)
    if kind in (".tif", ".tiff"):
        return read_tiff(data)
    if kind == ".nrrd":
        head, packed, at = _nrrd_header(data)
        raw = gzip.decompress(data[at:]) if packed in ("gzip", "gz") else data[at:]
        return np.frombuffer(raw, head.dtype, int(np.prod(head.shape))).reshape(head.shape)
    raw = gzip.decompress(data) if kind.endswith("gz") else data
    head, at = _nifti_header(raw)
    return np.frombuffer(raw, head.dtype, int(np.prod(head.shape)), at).reshape(head.shape)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length, modificationTime, content) of all image files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", "/", -1)
    known = F.lower(name).rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")
    return files.withColumn("name", name).where(known)


def headers(files: DataFrame) -> DataFrame:
    """(path, shape, dtype, spacing_um, error): a broken file is a row with its error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, name, data in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                try:
                    h = read_header(name, data)
                    rows.append((path, list(h.shape), h.dtype.lstrip("<>|="), list(h.spacing_um) if h.spacing_um else None, None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "spacing_um", "error"])

    return files.select("path", "name", "content").mapInPandas(run, "path string, shape array<int>, dtype string, spacing_um array<double>, error string")


def checked(name: str, v: np.ndarray) -> np.ndarray:
    """A volume of whole ids that are not negative, planes with one slice."""
    if v.ndim not in (2, 3):
        raise ValueError(f"{name}: {v.ndim} dimensions")
    if (v < 0).any() or (v.dtype.kind == "f" and (v % 1 != 0).any()):
        raise ValueError(f"{name}: ids are negative or not whole")
    return v if v.ndim == 3 else v[None]


def sparse_voxels(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, z, y, x, label) of all voxels that are not 0; planes have z = 0. Ids must be whole and not negative.

    Not strict: a file that cannot be read is one row with its ``error``.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for path, name, data in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                try:
                    v = checked(name, read_volume(name, data))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError) as e:
                    if strict:
                        raise
                    yield pd.DataFrame({"path": [path], "z": [None], "y": [None], "x": [None], "label": [None], "error": [str(e)]})
                    continue
                for z in range(len(v)):  # a plane at a time bounds the memory
                    y, x = np.nonzero(v[z])
                    out = {"path": path, "z": np.int32(z), "y": y.astype(np.int32), "x": x.astype(np.int32), "label": v[z][y, x].astype(np.int64)}
                    yield pd.DataFrame(out if strict else out | {"error": None})

    schema = "path string, z int, y int, x int, label long" + ("" if strict else ", error string")
    return files.select("path", "name", "content").mapInPandas(run, schema)
