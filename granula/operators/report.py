"""Report algebra: typed unions, roll-ups, deep-row joins and overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_union(frames: list[DataFrame], schema: T.StructType) -> DataFrame:
    """Frames of different shape by name, each cast to the declared types first."""

    def cast(df: DataFrame) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    return reduce(DataFrame.unionByName, map(cast, frames))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that no row fills: one aggregate over all columns."""
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c]])


def leading(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def roll_up(rows: DataFrame, key: str, sums: list[str], passed: list[str]) -> DataFrame:
    """Sums that skip nulls, and values passed through where the key has one row."""
    single = F.count(F.lit(1)) == 1
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.when(single, F.first(c)).alias(c) for c in passed])


def orphans(deep: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Deep rows whose owner is missing."""
    return deep.join(owners, on, "left_anti")


def beside(rows: DataFrame, names: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every name: up to ``most`` names, a proven bound, travel to the rows; more meet them in blocks of a product that neither side has to fit."""
    few = names.limit(most + 1).count() <= most
    return rows.crossJoin(F.broadcast(names) if few else names)


def missing_structures(present: DataFrame, objects: DataFrame, structures: DataFrame) -> DataFrame:
    """Objects times structures (a short list of names) minus what is present."""
    return beside(objects, structures).join(present, [*objects.columns, *structures.columns], "left_anti")


def composition(parts: DataFrame, whole: DataFrame, structures: DataFrame, key: str) -> DataFrame:
    """Percent of each structure (0 if absent) and the remainder of the whole; ``parts`` (key, structure, size), ``whole`` (key, total)."""
    dense = beside(whole, structures).join(parts, [key, "structure"], "left")
    share = dense.select(key, "structure", (100 * F.try_divide(F.coalesce("size", F.lit(0.0)), F.col("total"))).alias("percent"))
    rest = share.groupBy(key).agg((100 - F.sum("percent")).alias("percent")).select(key, F.lit("remainder").alias("structure"), "percent")
    return share.union(rest)


def recoloured(rows: DataFrame, palette: dict[str, str], name: str = "entity_name") -> DataFrame:
    """The colour column replaced: structures that the palette does not name become null."""
    pairs = [x for k, v in palette.items() for x in (F.lit(k), F.lit(v))]
    return rows.withColumn("entity_colour", F.create_map(*pairs)[F.col(name)])


def group_label(path: Column, groups: list[str]) -> Column:
    """The first given folder that is the path or above it; else the first part of a deeper path; else empty."""
    label = F.when(F.size(F.split(path, "/")) > 1, F.substring_index(path, "/", 1)).otherwise("")
    for g in reversed(groups):
        label = F.when((path == g) | path.startswith(g + "/"), g).otherwise(label)
    return label


def overview(objects: DataFrame, entities: DataFrame, instances: DataFrame, mask: str | None = None) -> DataFrame:
    """(objects, groups, instances, structures, dims, mixed): one row about a whole report.

    ``structures`` names the object mask first, then masks, then label structures, each by
    name; one that is a label anywhere counts as such. ``dims`` maps the number of dimensions
    to the objects that have it, ``mixed`` says whether there are several. ``objects``
    (object_id, group, spatial_dims), ``entities`` (entity_name, entity_kind), ``instances`` any
    rows, one each. Names and dimensions are few; a null group is none.
    """
    kinds = entities.groupBy("entity_name").agg(F.max((F.col("entity_kind") == "label").cast("int")).alias("label"))
    first = F.when(F.col("entity_name") == mask, 0).otherwise(1) if mask is not None else F.lit(1)
    order = F.sort_array(F.collect_list(F.struct(first.alias("a"), F.col("label").alias("b"), F.col("entity_name").alias("name"))))
    named = kinds.agg(F.transform(order, lambda x: x["name"]).alias("structures"))
    dims = objects.groupBy("spatial_dims").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("spatial_dims", "n")))).alias("dims"))
    counts = objects.agg(F.count_distinct("object_id").alias("objects"), F.count_distinct("group").alias("groups"))
    found = counts.crossJoin(F.broadcast(instances.agg(F.count(F.lit(1)).alias("instances")))).crossJoin(F.broadcast(named)).crossJoin(F.broadcast(dims))  # a row each
    return found.withColumn("mixed", F.size("dims") > 1)
