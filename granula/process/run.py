"""One call from folders to a report: discover, read, clip, crop, measure, type, stack, write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.functions import scalar, settings
from granula.functions.settings import RunConfig
from granula.functions.storage import stored
from granula.operators import graph, morphology, report
from granula.operators import rows as table
from granula.process import measurers as known
from granula.sources import discovery, images, report_sink, reports

LEVEL = {"object": 0, "entity": 1, "instance": 2, "distance": 2, "contact": 2, "baseline": 2}


def loaded(spark: SparkSession, root: str, config: RunConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(voxels, entities, objects, failures) of all object folders below ``root``.

    Nothing is dropped in silence: a file that cannot be read, a shape that differs from its
    source's or a missing voxel size makes its object a failure with the reason. Voxels are
    those of the chosen entities, clipped to the object mask and moved to its corner.
    """
    files = images.image_files(spark, root)
    found = stored(discovery.discovered(files.select("path", "length")), "process-discovery")
    dirs = discovery.object_dirs(found)
    found = found.join(dirs, "object_dir", "left_semi").where("role <> 'rejected'").withColumn("object_id", F.element_at(F.split("object_dir", "/"), -1))
    entities = found.where("role = 'entity'")
    if config.entities is not None:
        entities = table.chosen_entities(entities, list(config.entities), config.object_mask)
    heads = images.headers(files.join(found.select("path"), "path", "left_semi"))
    source = found.where("role = 'source'").select("object_id", "object_dir", F.col("path").alias("source")).join(heads.withColumnRenamed("path", "source"), "source", "left")
    config_size = F.array(*map(F.lit, config.voxel_size)) if config.voxel_size else F.lit(None).cast("array<double>")
    sized = table.voxel_size_choice(config_size, F.lit(None).cast("array<double>"), F.col("spacing_um"))
    objects = source.withColumns(sized)
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("voxel_size").isNull(), "no voxel size").when(F.size("voxel_size") != F.size("shape"), "the voxel size has other dimensions than the image")
    objects = stored(objects.withColumn("error", wrong), "process-objects")
    other = entities.select("object_id", "path").join(heads, "path").join(objects.select("object_id", F.col("shape").alias("s")), "object_id")
    shapes = other.where(F.col("error").isNotNull() | (F.col("shape") != F.col("s"))).select("object_id", F.coalesce("error", F.lit("an entity has another shape than the image")).alias("error"))
    pixels = images.sparse_voxels(files.join(entities.select("path"), "path", "left_semi"), strict=False)
    named = entities.select("path", "object_id", F.col("entity_name").alias("entity"), F.col("entity_kind").alias("kind"))
    pixels = stored(pixels.join(named, "path"), "process-pixels")
    failures = objects.where("error is not null").select("object_id", "error").union(shapes).union(pixels.where("error is not null").select("object_id", "error"))
    failures = stored(failures.groupBy("object_id").agg(F.min("error").alias("error")), "process-failures")
    good = objects.join(failures, "object_id", "left_anti").drop("error")
    voxels = pixels.where("error is null").join(failures, "object_id", "left_anti").select("object_id", "entity", "kind", "z", "y", "x", "label")

    # kinds that the name does not give: more than one id is a label volume; the object mask is a mask
    mask = config.object_mask
    ids = voxels.groupBy("object_id", "entity").agg(F.count_distinct("label").alias("ids"), F.max("label").alias("top"))
    declared = named.join(failures, "object_id", "left_anti").select("object_id", "entity", "kind").join(ids, ["object_id", "entity"], "left")
    if mask is not None:
        settings.choose_object_mask([tuple(r) for r in declared.select("entity", "kind").distinct().collect()], mask)
    auto = F.when(F.col("ids") > 1, "label").otherwise("mask")
    kind = F.when(F.col("entity") == mask, "mask") if mask is not None else F.when(F.lit(False), "mask")
    declared = declared.withColumn("entity_kind", kind.when(F.col("kind") == "auto", auto).otherwise(F.col("kind")))
    if config.label_map:
        names = dict(config.label_map)
        mapped = (F.col("kind") == "label") & ((F.col("entity") == config.label_map_entity) if config.label_map_entity else F.lit(True))
        split = morphology.split_labels(voxels.where(mapped).drop("kind").withColumn("entity", F.lit("*")), names, "*")
        voxels = voxels.where(~mapped).drop("kind").unionByName(split)
        made = split.select("object_id", "entity").distinct().withColumn("entity_kind", F.lit("mask"))
        declared = declared.where(~mapped).select("object_id", "entity", "entity_kind").unionByName(made)
    else:
        voxels = voxels.drop("kind")
    if mask is not None:
        voxels = morphology.cropped(morphology.clipped(voxels, mask) if config.clip else voxels, mask)
    kinds = declared.select("object_id", "entity", "entity_kind", F.lit(False).alias("declared"))
    voxels, kinds = graph.promoted(stored(voxels, "process-voxels"), kinds, mask, config.auto_label_masks, "process-parts")
    return stored(voxels, "process-stack"), stored(kinds, "process-kinds"), good, failures


def measured(spark: SparkSession, root: str, config: RunConfig, registry: tuple = known.REGISTRY) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): the typed long table of all objects below ``root``, and why others are missing."""
    voxels, kinds, objects, failures = loaded(spark, root, config)
    chosen = known.chosen(config.exclude, registry)
    files = images.image_files(spark, root).select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    own = F.element_at(F.split("path", "/"), -2)
    facts = table.file_facts(files.select(F.when(own.isin(*discovery.ENTITY_FOLDERS), F.element_at(F.split("path", "/"), -3)).otherwise(own).alias("object_id"), "path", "length", "modified"))
    parts: list[DataFrame] = []
    for size in [tuple(r[0]) for r in objects.select("voxel_size").distinct().collect()]:  # voxel sizes, of which a batch has few
        mine = objects.where(F.col("voxel_size") == F.array(*map(F.lit, size))).select("object_id", "object_dir", "shape", "voxel_size_source")
        batch = known.Batch(voxels.join(mine.select("object_id"), "object_id", "left_semi"), kinds.join(mine.select("object_id"), "object_id", "left_semi"), size, config)
        tables = known.merged([m.measure(batch) for m in chosen])
        tables.setdefault("object", mine.select("object_id"))
        axes = "zyx"[3 - len(size) :]
        about = mine.join(facts, "object_id", "left").withColumns(
            {f"pixel_size_{a.upper()}": F.lit(s) for a, s in zip(axes, size, strict=True)} | {f"size_{a.upper()}": F.element_at("shape", k + 1).cast("long") for k, a in enumerate(axes)}
            | {"spatial_dims": F.lit(len(size)).cast("long"), "group": report.group_label(scalar_path(root), list(config.groups)), "object_mask_name": F.lit(config.object_mask)}
        )
        tables["object"] = tables["object"].join(about.drop("shape", "object_dir"), "object_id")
        for kind, df in tables.items():
            typed = scalar.finite_columns(df).withColumns({"row_type": F.lit(kind), "obs_level": F.lit(LEVEL[kind]).cast("long")})
            if kind == "entity":
                typed = typed.join(about.select("object_id", "group"), "object_id")
            parts.append(typed)
    if not parts:
        raise ValueError("no object could be measured")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = report.drop_empty_columns(stored(rows, "process-rows"))
    return report.leading(rows, list(table.LEADING)), failures


def scalar_path(root: str):
    """The folder of an object below ``root``, without it."""
    base = root.rstrip("/")
    tail = base.rsplit("/", 1)[-1]
    return F.regexp_replace("object_dir", f"^.*?/{tail}/", "")


def process(spark: SparkSession, root: str, output: str, config: RunConfig | None = None, palette: dict[str, str] | None = None, **about: str) -> DataFrame:
    """Measure everything below ``root`` and write the report, a folder of files if ``output`` ends in a slash; returns the failures (object_id, error)."""
    config = config or RunConfig()
    rows, failures = measured(spark, root, config)
    if palette:
        rows = report.recoloured(rows, palette)
    write = report_sink.write_report if output.endswith("/") else reports.write_report  # a folder is written by the tasks, one file by one
    write(rows, output, known.descriptions(known.chosen(config.exclude)), config.noun, base_dir=root, loader="folders", fingerprint=config.fingerprint(), **about)
    return failures


def dry_run(spark: SparkSession, root: str, config: RunConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(presence of entities, problems, memory by object) from names and headers alone."""
    config = config or RunConfig()
    files = images.image_files(spark, root)
    found = discovery.discovered(files.select("path", "length")).withColumn("object_id", F.element_at(F.split("object_dir", "/"), -1))
    heads = images.headers(files)
    entities = found.where("role = 'entity'")
    bad = found.where("role = 'rejected'").select("path", F.col("reason").alias("problem"))
    source = found.where("role = 'source'").join(heads, "path")
    if config.voxel_size is None:
        bad = bad.union(source.where("error is null and spacing_um is null").select("path", F.lit("no voxel size")))
    problems = bad.union(heads.where("error is not null").select("path", F.col("error")))
    sizes = source.where("error is null").select("object_id", F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b).alias("voxels"))
    count = entities.groupBy("object_id").agg(F.count(F.lit(1)).alias("entities"))
    memory = sizes.join(count, "object_id").select("object_id", scalar.memory_estimate(F.col("voxels"), F.col("entities")).alias("bytes"))
    return table.entity_presence(entities), problems, memory
