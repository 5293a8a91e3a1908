"""Measures in SQL: SELECT * FROM measure(TABLE(voxels) PARTITION BY (object_id), 'morphology').

A measure is a class that adds up batches of one object's voxels and gives its rows at the end;
it holds sums by instance and never the voxels. New ones are registered by name and are at
once known to the table function. Several names, parted by commas, are measured in one pass.

Spark looks at each row of such a table in Python, so voxels should come packed: z, y and x may
be arrays, a row for many voxels of an instance, as ``packed`` makes them.

Defined results: without voxels there are no rows; voxels with a null object_id form an object
of their own; an unknown name is an error; columns other than entity, z, y, x and label are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

#: Side of the cubes whose voxels share a row.
PACK = 8
SCHEMA = "object_id string, entity string, label long, metric string, value double"


class Measure(Protocol):
    """What a name stands for; one object a partition."""

    def __init__(self, spacing: Sequence[float]): ...

    def add(self, entity: np.ndarray, label: np.ndarray, at: np.ndarray) -> None: ...

    def rows(self) -> Iterator[tuple[str, int, str, float]]: ...


class Sums:
    """Per instance, arrays in ``held`` that grow by one entry for each new (entity, label); ask for ``places`` before an array, as it makes longer ones."""

    FIELDS: tuple[str, ...] = ()

    def __init__(self, spacing: Sequence[float]):
        self.spacing, self.at, self.names = tuple(spacing), {}, []
        self.held = {f: np.empty(0) for f in self.FIELDS}

    def places(self, entity: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The number of each row's instance."""
        kinds = pa.array(entity, pa.string()).dictionary_encode("encode")
        labels, code = np.unique(label, return_inverse=True)
        pairs, back = np.unique(kinds.indices.to_numpy().astype(np.int64) * len(labels) + code, return_inverse=True)
        names = kinds.dictionary.to_pylist()
        own = [(str(names[k]), int(labels[v])) for k, v in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(labels)))), strict=True)]
        for name in own:
            if name not in self.at:
                self.at[name] = len(self.names)
                self.names.append(name)
        for f, values in self.held.items():
            self.held[f] = np.concatenate([values, np.full(len(self.names) - len(values), self.start(f))])
        return np.array([self.at[name] for name in own], np.int64)[back.ravel()]

    def start(self, field: str) -> float:
        return 0.0


class Morphology(Sums):
    """Size and centre of each instance."""

    FIELDS = ("n", "z", "y", "x")

    def add(self, entity: np.ndarray, label: np.ndarray, at: np.ndarray) -> None:
        own = self.places(entity, label)
        np.add.at(self.held["n"], own, 1)
        for k, a in enumerate("zyx"):
            np.add.at(self.held[a], own, at[:, k])

    def rows(self) -> Iterator[tuple[str, int, str, float]]:
        for k, (entity, label) in enumerate(self.names):
            n = self.held["n"][k]
            yield entity, label, "volume_um3", n * float(np.prod(self.spacing))
            for a, s in zip("zyx", self.spacing, strict=True):
                yield entity, label, f"{a}_um", self.held[a][k] / n * s


class Boxes(Sums):
    """Corners and filled share of each instance's box."""

    FIELDS = ("n", "min_z", "max_z", "min_y", "max_y", "min_x", "max_x")

    def start(self, field: str) -> float:
        return {"n": 0.0, "min": np.inf}.get(field[:3], -np.inf) if field != "n" else 0.0

    def add(self, entity: np.ndarray, label: np.ndarray, at: np.ndarray) -> None:
        own = self.places(entity, label)
        np.add.at(self.held["n"], own, 1)
        for k, a in enumerate("zyx"):
            np.minimum.at(self.held[f"min_{a}"], own, at[:, k])
            np.maximum.at(self.held[f"max_{a}"], own, at[:, k])

    def rows(self) -> Iterator[tuple[str, int, str, float]]:
        for k, (entity, label) in enumerate(self.names):
            volume = 1.0
            for a in "zyx":
                low, high = self.held[f"min_{a}"][k], self.held[f"max_{a}"][k]
                volume *= high - low + 1
                yield entity, label, f"min_{a}", low
                yield entity, label, f"max_{a}", high
            yield entity, label, "fill_ratio", self.held["n"][k] / volume


MEASURES: dict[str, type] = {"morphology": Morphology, "boxes": Boxes}


def packed(voxels: DataFrame) -> DataFrame:
    """``voxels`` (object_id, entity, z, y, x, label) with arrays for z, y and x: a row for the voxels of an instance in a cube of PACK."""
    cube = [F.floor(F.col(a) / PACK).alias(f"c{a}") for a in "zyx"]
    rows = voxels.groupBy("object_id", "entity", "label", *cube).agg(F.collect_list(F.struct("z", "y", "x")).alias("v"))
    return rows.select("object_id", "entity", *[F.col(f"v.{a}").alias(a) for a in "zyx"], "label")


def _unpacked(voxels: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entity, label and place of each voxel of a batch, packed or not."""
    entity, label = np.array(voxels.column("entity").to_pylist(), object), voxels.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    at = [voxels.column(a) for a in "zyx"]
    if pa.types.is_list(at[0].type):
        n = pc.list_value_length(at[0]).to_numpy(zero_copy_only=False)
        entity, label, at = np.repeat(entity, n), np.repeat(label, n), [a.flatten() for a in at]
    return entity, label, np.stack([a.to_numpy(zero_copy_only=False) for a in at], 1).astype(np.float64)


def register(spark: SparkSession, spacing: Sequence[float] = (1.0, 1.0, 1.0), more: dict[str, type] | None = None, name: str = "measure") -> None:
    """Make ``name`` known in SQL: a table function of a table of voxels, partitioned by object, and the name of a measure."""
    known, size = MEASURES | (more or {}), tuple(spacing)

    @arrow_udtf(returnType=SCHEMA)
    class Measured:
        def __init__(self):
            self.measures, self.object = [], None

        def eval(self, voxels: pa.RecordBatch, measure: pa.Array):
            if voxels.num_rows:
                if not self.measures:
                    called = [name.strip() for name in measure[0].as_py().split(",")]
                    for name in called:
                        if name not in known:
                            raise ValueError(f"no measure is called {name!r}; there are {', '.join(sorted(known))}")
                    self.measures, self.object = [known[name](size) for name in called], voxels.column("object_id")[0].as_py()
                rows = _unpacked(voxels)
                for one in self.measures:
                    one.add(*rows)
            return iter(())

        def terminate(self):
            found = [row for one in self.measures for row in one.rows()]
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.float64())
            named = dict(zip(("entity", "label", "metric", "value"), (pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), strict=True))
            yield pa.table({"object_id": pa.array([None if self.object is None else str(self.object)] * len(found), pa.string())} | named)

    spark.udtf.register(name, Measured)
