"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract: a space or one of TAB, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    Taken from the session; only a session in local mode that names none gets a
    temporary folder of its own.
    """
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="granula-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Inclusive running ``combine`` over an array in O(n log n), by doubling steps."""
    n = F.size(values)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))

    def step(so_far: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        kept = F.greatest(F.size(so_far) - back, F.lit(0))
        moved = F.concat(F.array_repeat(neutral, F.least(back, F.size(so_far))), F.slice(so_far, F.lit(1), kept))
        return F.zip_with(so_far, moved, combine)

    return F.aggregate(steps, values, step)


def drop_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names are compared as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_thread() -> None:
    """Let numpy's matrix products in this process use one thread: a task has one core, and threads that wait for work would spin on others'."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        found = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(found, name):
                getattr(found, name)(1)
                break


def keep_memory(size: int = 1 << 26) -> None:
    """Let this process keep up to ``size`` bytes that arrays of one step free for those of the next, instead of fetching fresh pages each time (glibc only)."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, size)  # M_MMAP_THRESHOLD
        mallopt(-1, size)  # M_TRIM_THRESHOLD


_received: dict[bytes, object] = {}


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size so that workers without this package can read it, too."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    """The value of send(), one object for all tasks of a worker process."""
    key = hashlib.blake2b(sent.value).digest()
    if key not in _received:
        _received.clear()  # a worker needs the value of its own stage only
        _received[key] = cloudpickle.loads(sent.value)
    return _received[key]
