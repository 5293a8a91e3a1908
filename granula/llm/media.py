"""Media columns: Netpbm and BMP images as numpy arrays, resized tiles and difference hashes.

Images are decoded to (height, width, channels) arrays of bytes, area-resized by integral
images (each target cell is the mean of the source area it covers, with fractional edges)
and written as NPY tiles. One pass over the rows, no shuffle; memory is that of one Arrow
batch, HELD images and the running sums of one (24 bytes a sample), so a very long text is
one image of its own size.

Defined results: a null blob decodes to null; a blob in no known format raises in strict
mode and else gives nulls; empty texts are one row of spaces; a target size larger than the
image repeats pixels; equal bytes give equal results. Other columns pass through; columns
named like a result column are replaced; repeated rows and null ids are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.llm.base import drop_clashes, slices, table

#: Bytes of a row of 64 RGB pixels.
ROW_BYTES = 192
#: Rows whose images are held at once.
HELD = 256


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 (one channel) or P6 (three) with 8-bit samples."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, with comments skipped, and the offset after the last and one white space."""
    values, at = [], 2
    while len(values) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        start = at
        while data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("a Netpbm header lacks a number")
        values.append(int(data[start:at]))
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Bitmaps become 0 (set) and 255; 16-bit samples keep their high byte."""
    kind = int(data[1:2])
    bitmap = kind in (1, 4)
    values, at = _header(data, 2 if bitmap else 3)
    w, h = values[:2]
    channels = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind == 1:
        bits = np.frombuffer(b"".join(data[at - 1 :].split()), np.uint8)[: w * h] - ord("0")
        return ((1 - bits) * 255).astype(np.uint8).reshape(h, w, 1)
    if kind in (2, 3):
        samples = np.array(data[at - 1 :].split()[: w * h * channels], np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if values[2] < 256 else ">u2", w * h * channels, at)
    if values[2] != 255:
        samples = samples.astype(np.int64) * 255 // values[2]
    return samples.astype(np.uint8).reshape(h, w, channels)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first, rows padded to four bytes."""
    h, w, c = pixels.shape
    rgb = np.repeat(pixels, 3, axis=2) if c == 1 else pixels
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24-bit and 32-bit BMP; a negative height is top row first."""
    offset, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError(f"BMP with {depth} bits and compression {packed} is not supported")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area of each target cell, by one integral image; float64 (height, width, channels)."""
    h, w, c = pixels.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(pixels, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at_edges(values: np.ndarray, n: int, size: int) -> np.ndarray:
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(int), size - 1)
        part = (edges - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    rows = np.diff(at_edges(total, height, h), axis=0)
    cells = np.diff(at_edges(rows.swapaxes(0, 1), width, w), axis=0).swapaxes(0, 1)
    return cells / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """Hexadecimal bits: is a cell darker than its right neighbour, on a grid of side rows and side + 1 columns."""
    grey = area_resized(pixels, side, side + 1).mean(axis=2)
    return np.packbits(np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, column: str = "media", tile: int = 32, strict: bool = True) -> DataFrame:
    """``df`` with height, width, channels, tile_npy (tile x tile x channels bytes) and dhash of the images in ``column``.

    Write the result with ``df.write.parquet`` to keep the tiles.
    """
    added = [T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")] + [T.StructField("tile_npy", T.BinaryType()), T.StructField("dhash", T.StringType())]
    rows = drop_clashes(df, [f.name for f in added if f.name.lower() != column.lower()])
    columns = rows.columns
    at = columns.index(column)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        try:
            pixels = decode(data)
            h, w, c = pixels.shape
            small = np.rint(area_resized(pixels, tile, tile)).astype(np.uint8)
            return h, w, c, npy(small), difference_hash(pixels)
        except (ValueError, IndexError, struct.error):
            if strict:
                raise
            return (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            found = [one(b) for b in batch.column(at).to_pylist()]
            kinds = [pa.int32()] * 3 + [pa.binary(), pa.string()]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*columns, *[f.name for f in added]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def text_images(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """``df`` with the UTF-8 bytes of each text as a P6 image of 64 pixels a row, padded with spaces; null is empty."""
    rows = drop_clashes(df, [name, "n_bytes"])
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(body)
    high = F.greatest(F.lit(1), F.ceil(n / ROW_BYTES)).cast("int")
    head = F.concat(F.lit("P6\n64 "), high.cast("string"), F.lit("\n255\n")).cast("binary")
    pad = F.repeat(F.lit(" "), (high * ROW_BYTES - n).cast("int")).cast("binary")
    return rows.withColumn(name, F.concat(head, body, pad)).withColumn("n_bytes", n.cast("long"))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as an image, read back and hashed; tile_npy is its area-resized tile as an NPY file.

    ``feature`` is the difference hash of the image, and the CRC-32 of the tile.
    """
    docs = text_images(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            out = []
            for data in batch.column(2).to_pylist():
                pixels = decode(data)
                payload = pixels.tobytes()
                tile = npy(np.rint(area_resized(pixels, 8, 8)).astype(np.uint8))
                feature = f"{difference_hash(pixels)}:{zlib.crc32(tile):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, tile))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy")
            new = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"
    return docs.mapInArrow(run, schema)
