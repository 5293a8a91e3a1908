"""Cell folders: cells derived from membranes and seeds in bricks, each written by a task with its mask and a manifest."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.functions.settings import box_text
from granula.functions.storage import spread, stored
from granula.operators import flood
from granula.sources import images


def read(spark: SparkSession, files: dict[str, str | None]) -> tuple[DataFrame, tuple[int, ...]]:
    """(voxels (object_id, entity, z, y, x), shape) of image files by entity: membrane, seed and, if given, outside; shapes must agree."""
    voxels, shapes = None, {}
    for entity, path in files.items():
        if path is None:
            continue
        file = images.image_files(spark, path)
        head = images.headers(file).first()
        if head is None or head.error is not None:
            raise ValueError(f"{path}: {head.error if head else 'no image'}")
        shapes[entity] = tuple(head.shape)
        own = images.sparse_voxels(file).select(F.lit("volume").alias("object_id"), F.lit(entity).alias("entity"), "z", "y", "x")
        voxels = own if voxels is None else voxels.unionByName(own)
    if len(set(shapes.values())) != 1:
        raise ValueError("the images differ in shape: " + ", ".join(f"{k} {v}" for k, v in shapes.items()))
    shape = next(iter(shapes.values()))
    return voxels, shape if len(shape) == 3 else (1, *shape)


def touches(low: np.ndarray, high: np.ndarray, shape: tuple[int, ...]) -> str:
    """The axes whose ends a box from ``low`` up to, without, ``high`` touches, as a text of z, y and x."""
    return "".join(a for a, lo, hi, n in zip("zyx", low, high, shape, strict=True) if n > 1 and (lo == 0 or hi == n))


def write_folder(folder: str, at: np.ndarray, low: np.ndarray, high: np.ndarray, spacing: tuple[float, ...], store: str, entities: dict[str, str], how: dict) -> None:
    """The mask of one cell in its own box as TIFF, and source.json with the crop and how it was derived."""
    own = np.zeros(high - low, np.uint8)
    own[tuple((at - low).T)] = 1
    flat = len(spacing) == 2
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "cell_mask.tif").write_bytes(images.write_tiff(own[0] if flat else own, spacing))
    box = list(zip(low.tolist(), high.tolist(), strict=True))[int(flat) :]
    said = {"store": store, "crop": box_text(box), "entities": entities, "object_mask": "cell", "voxel_size_um": list(spacing), "derived": how}
    (Path(folder) / "source.json").write_text(json.dumps(said, indent=1))


def write_cells(cells: DataFrame, root: str, shape: tuple[int, ...], spacing: tuple[float, ...], store: str, entities: dict[str, str] | None = None, how: dict | None = None, drop_edge: bool = False) -> DataFrame:
    """(label, folder) of the folders made for ``cells`` (z, y, x, label); each is written by one task, which holds that cell's box.

    ``root`` is a folder that all executors reach. With ``drop_edge`` cells that touch an end of the volume have none.
    """
    entities, how = entities or {}, how or {}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = np.stack([rows[a].to_numpy() for a in "zyx"], 1).astype(np.int64)
        low, high, label = at.min(axis=0), at.max(axis=0) + 1, key[0].as_py()
        edge = touches(low, high, shape)
        folder = f"{root}/cell_{label:04d}"
        made = not (drop_edge and edge)
        if made:
            write_folder(folder, at, low, high, spacing, store, entities, how | {"cell": label, "touches": edge})
        return pa.table({"label": pa.array([label] * made, pa.int32()), "folder": pa.array([folder] * made, pa.string())})

    rows = cells.select("label", "z", "y", "x")
    return stored(spread(rows, "label").groupBy("label").applyInArrow(run, "label int, folder string"), "cell-folders")


def derive(
    spark: SparkSession, membrane: str, seeds: str, outside: str | None, output: str, spacing: tuple[float, ...], walls: int = 3, least_um3: float = 40.0, reach_um: float | None = None, store: str | None = None,
    entities: dict[str, str] | None = None, drop_edge: bool = False,
) -> DataFrame:
    """Read the images, part the cells and write a folder for each; returns (label, folder)."""
    voxels, shape = read(spark, {"membrane": membrane, "seed": seeds, "outside": outside})
    size = spacing if len(spacing) == 3 else (1.0, *spacing)
    found = stored(flood.cells(voxels, shape, size, walls, least_um3, reach_um), "cells")
    return write_cells(found, output, shape, spacing, store or membrane, entities, {"walls": walls, "least_um3": least_um3, "reach_um": reach_um}, drop_edge)
