"""Tables in the shared checkpoint folder, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
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
    """``df`` written as Parquet under the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return unsent(df.sparkSession.read.schema(df.schema).parquet(path))


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are dealt by key, and never sent whole to the driver and all tasks.

    For sides that grow with the input: Spark guesses their size from packed files and from
    generated rows, far too small, and would broadcast them. The hint holds through what is
    selected, filtered or grouped from ``df``, up to the next join or union; F.broadcast of a
    side that is known to be small goes before it.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to the session's number of shuffle partitions, for kernels that cost far more than their bytes.

    Adaptive execution would put such groups together by their size; grouping by the same keys
    afterwards needs no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
