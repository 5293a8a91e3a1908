"""Incremental measuring: objects without a trusted part are measured and land as parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def remaining(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Objects (object_key, fingerprint, ...) without a part of the same fingerprint."""
    return objects.join(parts.select("object_key", "fingerprint").distinct(), ["object_key", "fingerprint"], "left_anti")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def has_parts(spark: SparkSession, parts: str) -> bool:
    """Whether any part has landed, by the folder's listing."""
    fs, at = _folder(spark, parts)
    return bool(fs.exists(at)) and any(s.getPath().getName().startswith("part-") for s in fs.listStatus(at))


def discard_parts(spark: SparkSession, parts: str, failures: DataFrame) -> bool:
    """Delete all parts once a report without failures is written; with failures they stay for the next run."""
    if not failures.isEmpty():
        return False
    fs, at = _folder(spark, parts)
    return bool(fs.delete(at, True)) if fs.exists(at) else False


def run_available(spark: SparkSession, manifests: str, schema: str, measure: Callable[[DataFrame], DataFrame], parts: str, checkpoint: str) -> None:
    """Measure all manifest rows (JSON lines) that are new since the last run and append their rows to ``parts``.

    Each batch lands under its number, so a batch that runs again after a failure overwrites
    itself; objects whose part has the same fingerprint are left out.
    """

    def land(batch: DataFrame, number: int) -> None:
        if has_parts(spark, parts):
            done = spark.read.option("recursiveFileLookup", "true").parquet(parts).where(f"batch <> {number}")
            batch = remaining(batch, done)
        from pyspark.sql import functions as F

        measure(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{parts}/part-{number}")

    source = spark.readStream.schema(schema).json(manifests)
    query = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
