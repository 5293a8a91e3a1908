"""Queries over geometry files: summaries, chosen structures and galleries; payloads are read only where they are returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.functions import scalar


def has_geometry(surface: str = "surface", outline: str = "outline") -> Column:
    return F.col(surface).isNotNull() | F.col(outline).isNotNull()


def size_expression(columns: list[str]) -> Column:
    """What rows are ordered by: the volume, else the area, of the columns that the file has."""
    have = [F.col(c) for c in ("volume_um3", "area_um2") if c in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def source_of(spark, paths: list[str]) -> DataFrame:
    """Several geometry files as one table, with the file of each row; columns that only some files have are null in the others."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("filename", F.input_file_name())


def owners(rows: DataFrame) -> DataFrame:
    """(object_id, filename): whose rows a file holds, by the column and not by the folder's name."""
    return rows.select("object_id", "filename").distinct()


def summary(rows: DataFrame) -> DataFrame:
    """(entity_name, row_type, n, elements) without reading payloads."""
    return rows.groupBy("entity_name", "row_type").agg(F.count(F.lit(1)).alias("n"), F.sum("surface_elements").alias("elements"))


def geometry(rows: DataFrame, structures: list, metrics: list[str]) -> DataFrame:
    """The chosen structures with metrics and payloads, the biggest first, those without a size last."""
    found = rows.where(F.col("entity_name").isin(structures)).withColumn("size", size_expression(rows.columns))
    payloads = [c for c in ("surface", "skeleton", "outline") if c in rows.columns]
    return found.select("object_id", "entity_name", "row_type", "label", *metrics, "size", *payloads).orderBy(F.col("size").desc_nulls_last(), "entity_name", "label")


def edges(rows: DataFrame, reach: float) -> DataFrame:
    """Contact rows whose gap is within reach."""
    return rows.where((F.col("row_type") == "contact") & (F.col("gap_um") <= reach)).select("entity_a", "label_a", "entity_b", "label_b")


def widest_gap(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("gap_um").alias("gap_um"))


def gallery_rows(rows: DataFrame, metric: str, row_type: str = "instance") -> DataFrame:
    """Rows of one kind that have a geometry and a finite metric."""
    return rows.where((F.col("row_type") == row_type) & has_geometry() & scalar.finite(F.col(metric)).isNotNull())


def gallery(rows: DataFrame, metric: str, pick: str, k: int, row_type: str = "instance") -> DataFrame:
    """k rows with the highest, the lowest or (by a hash of the label) random metrics, then shown by falling metric."""
    order = {"highest": F.col(metric).desc(), "lowest": F.col(metric).asc(), "random": F.md5(F.col("label").cast("string")).asc()}[pick]
    return gallery_rows(rows, metric, row_type).orderBy(order, "label").limit(k).orderBy(F.col(metric).desc(), "label")


def metric_span(rows: DataFrame, metric: str) -> DataFrame:
    """(entity_name, low, high) over a structure's whole population of finite values."""
    value = scalar.finite(F.col(metric))
    return rows.groupBy("entity_name").agg(F.min(value).alias("low"), F.max(value).alias("high"))
