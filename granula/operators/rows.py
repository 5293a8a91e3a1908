"""The typed table: its row kinds, joins between them, and what a run knows of its folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_TYPES = ("object", "entity", "instance", "distance", "contact", "baseline")
LEADING = ("obs_level", "row_type", "object_id", "group", "entity_name", "instance_entity", "instance_label")


def only(rows: DataFrame, kind: str) -> DataFrame:
    """One row kind; on a report partitioned by row_type other files are not read."""
    if kind not in ROW_TYPES:
        raise ValueError(f"{kind!r} is no row kind")
    return rows.where(F.col("row_type") == kind)


def adapted(rows: DataFrame) -> dict[str, DataFrame]:
    """The report taken apart: a table for each row kind; every row is in one of them."""
    return {kind: only(rows, kind) for kind in ROW_TYPES}


def object_count(rows: DataFrame) -> DataFrame:
    return rows.where("obs_level = 0").agg(F.count(F.lit(1)).alias("objects"))


def deep(rows: DataFrame, kind: str) -> DataFrame:
    """Distance or contact rows with the columns that readers use and no others, so that a scan reads only those."""
    from granula.functions.settings import DEEP_COLUMNS

    return only(rows, kind).select(*DEEP_COLUMNS[kind])


def chosen_entities(rows: DataFrame, names: list[str], mask: str | None = None, column: str = "entity_name") -> DataFrame:
    """Rows of the named entities and the object mask; a name that no row has is an error."""
    known = {r[0] for r in rows.select(column).distinct().where(F.col(column).isin(names)).collect()}  # no more than the given names
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"no entity is called {', '.join(map(str, unknown))}")
    return rows.where(F.col(column).isin([*names, *([mask] if mask is not None else [])]))


def with_kind(deep_rows: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Deep rows with the kind of their entity; left, by object and entity."""
    kinds = entities.select("object_id", F.col("entity_name").alias(entity), "entity_kind")
    return deep_rows.join(kinds, ["object_id", entity], "left")


def with_extras(entities: DataFrame, extras: DataFrame) -> DataFrame:
    """Entity rows with columns that other measurers give by object and entity name."""
    return entities.join(extras, ["object_id", "entity_name"], "left")


def with_metrics(geometry: DataFrame, instances: DataFrame, metrics: list[str]) -> DataFrame:
    """Geometry rows with the metrics of their instance, without the prefix of instance rows; left, on object, entity and label."""
    names = {m: m.removeprefix("instance_") for m in metrics}
    found = instances.select("object_id", F.col("instance_entity").alias("entity_name"), F.col("instance_label").alias("label"), *[F.col(m).alias(n) for m, n in names.items()])
    return geometry.join(found, ["object_id", "entity_name", "label"], "left")


def scene_metric(geometry: DataFrame, wide: DataFrame, metric: str) -> DataFrame:
    """(entity_name, label, value): a metric of the report on the rows of a scene that have one."""
    found = wide.select("object_id", F.col("instance_entity").alias("entity_name"), F.col("instance_label").alias("label"), F.col(metric).alias("value"))
    return geometry.select("object_id", "entity_name", "label").join(found.where("value is not null"), ["object_id", "entity_name", "label"])


def object_facts(files: DataFrame, extents: DataFrame) -> DataFrame:
    """Provenance and extent of each object in one row."""
    return file_facts(files).join(extents, "object_id", "left")


def file_facts(files: DataFrame) -> DataFrame:
    """(object_id, size_bytes, modification_date, file_extension) of (object_id, path, length, modified): the extension where there is only one."""
    ending = F.lower(F.regexp_extract("path", r"(\.nii\.gz|\.[^./]+)$", 1))
    one = F.when(F.count_distinct(ending) == 1, F.max(ending))
    return files.groupBy("object_id").agg(F.sum("length").alias("size_bytes"), F.max("modified").alias("modification_date"), one.alias("file_extension"))


def entity_presence(entities: DataFrame) -> DataFrame:
    """How many objects hold each kind and name."""
    return entities.groupBy("entity_kind", "entity_name").agg(F.count_distinct("object_id").alias("objects"))


def voxel_size_choice(config: Column, manifest: Column, header: Column) -> dict[str, Column]:
    """The voxel size by precedence, and where it comes from; null without any."""
    source = F.when(config.isNotNull(), "command line").when(manifest.isNotNull(), "manifest").when(header.isNotNull(), "header")
    return {"voxel_size": F.coalesce(config, manifest, header), "voxel_size_source": source}


def carried(coarse: DataFrame, fine_shape: DataFrame) -> DataFrame:
    """A mask of a coarse grid on a fine one, each fine voxel from the coarse voxel its index falls on; ratios may be fractional.

    ``coarse``: (object_id, z, y, x) of the mask; ``fine_shape``: (object_id, nz, ny, nx, cz, cy, cx), both shapes.
    A coarse voxel knows the fine indices it covers, so no fine voxel outside the mask is made.
    """
    rows = coarse.join(fine_shape, "object_id")
    for a in "zyx":
        n, c = F.col(f"n{a}"), F.col(f"c{a}")
        low, high = (F.ceil((F.col(a) + d) * n / c).cast("int") for d in (0, 1))
        rows = rows.withColumn(f"f{a}", F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.select("object_id", *[F.col(f"f{a}").alias(a) for a in "zyx"])


def branch_values(asked: Column, measured: Column, branches: Column, length: Column) -> dict[str, Column]:
    """Not measured against zero: null where skeletons were not asked for or not possible, else 0 branches and 0 length for an empty one."""
    there = asked & measured
    return {"instance_branches": F.when(there, F.coalesce(branches, F.lit(0))), "instance_length_um": F.when(there, F.coalesce(length, F.lit(0.0)))}


def structure_colours(names: DataFrame, palette_size: int = 0) -> DataFrame:
    """(entity_name, colour): the report's colour, else one of many distinct ones by the place of the name among all names (few)."""
    from granula.functions.settings import distinct_colour

    found = names.groupBy("entity_name").agg(F.max("entity_colour").alias("given"))
    at = found.withColumn("k", F.row_number().over(W.orderBy("entity_name")) - 1)
    own = F.udf(distinct_colour)
    return at.select("entity_name", F.coalesce("given", own(F.col("k"))).alias("colour"))


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the objects that went well, and (object_id, error) of the others."""
    return results.where("error is null").drop("error"), results.where("error is not null").select("object_id", "error")
