"""Chunked arrays as a Spark data source: spark.read.format("voxel_chunks").load(array).

One partition for each chunk that the wanted box meets; no other chunk is opened. The box is the
option ``box`` ("z0:z1,y0:y1,x0:x1", ends may be left out) and what a query asks of z, y and x:
comparisons with constants narrow it before partitions are made, if the session lets Python
sources have filters (register() sees to that). Coordinates count from the corner of the
option's box.

Defined results: samples that are 0 and chunks that were never written have no rows; a box
without chunks gives an empty table; planes have z = 0; an array that is neither Zarr nor N5,
of other dimensions or in a compression that is not supported is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "z int, y int, x int, label long"


class Chunk(InputPartition):
    def __init__(self, place: tuple[int, ...]):
        self.place = place


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, box: str | None):
        from granula.sources.stores import array_info

        self.path, self.info = path, array_info(path)
        shape = self.info["shape"]
        if len(shape) not in (2, 3):
            raise ValueError(f"{path}: {len(shape)} dimensions")
        self.axes = "zyx"[3 - len(shape) :]
        parts = [p.split(":") for p in box.split(",")] if box else [["", ""]] * len(shape)
        if len(parts) != len(shape) or any(len(p) != 2 for p in parts):
            raise ValueError(f"{box!r} is no box of {len(shape)} dimensions")
        self.low = [min(max(0, int(lo or 0)), n) for (lo, _), n in zip(parts, shape, strict=True)]
        self.high = [max(lo, min(int(hi), n) if hi else n) for (_, hi), n, lo in zip(parts, shape, self.low, strict=True)]
        self.corner = list(self.low)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name is None or name not in self.axes or not isinstance(f.value, int):
                yield f
                continue
            k = self.axes.index(name)
            at = f.value + self.corner[k]
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.low[k] = max(self.low[k], at)
            if isinstance(f, GreaterThan):
                self.low[k] = max(self.low[k], at + 1)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                self.high[k] = min(self.high[k], at + 1)
            if isinstance(f, LessThan):
                self.high[k] = min(self.high[k], at)

    def partitions(self) -> list[InputPartition]:
        ranges = [range(lo // c, -(-hi // c)) if hi > lo else range(0) for lo, hi, c in zip(self.low, self.high, self.info["chunks"], strict=True)]
        return [Chunk(place) for place in product(*ranges)]  # their names, not their samples

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        from granula.sources.stores import read_chunk

        found = read_chunk(self.path, self.info, partition.place) if partition is not None else None
        if found is None:
            return
        at = np.argwhere(found)
        index = at + np.array(partition.place) * np.array(self.info["chunks"])
        keep = ((index >= self.low) & (index < self.high)).all(axis=1)
        at, index = at[keep], index[keep] - np.array(self.corner)
        z = index[:, 0] if index.shape[1] == 3 else np.zeros(len(index), np.int64)
        cols = [pa.array(c.astype(np.int32)) for c in (z, index[:, -2], index[:, -1])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found[tuple(at.T)].astype(np.int64))], ["z", "y", "x", "label"])


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxel_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        if "path" not in self.options:
            raise ValueError("say which array to load")
        return ChunkReader(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("box"))


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
