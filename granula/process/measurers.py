"""Measurers: each takes a batch of objects of one voxel size and gives the rows of its kinds.

A measurer is any object with NAME, DESCRIPTION, COLUMN_DESCRIPTIONS and ``measure(batch)``,
which returns tables by row kind; object and entity tables are joined on, deep ones stacked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.settings import RunConfig, extent_keys
from granula.functions.storage import stored, unsent
from granula.operators import branches, bricks, contacts, distance, morphology, polarity, report, rows, skeleton, thinning

INSTANCE = ["object_id", "entity", "label"]


@dataclass
class Batch:
    """Objects of one dimension and spacing: voxels (object_id, entity, z, y, x, label) and entities (object_id, entity, entity_kind)."""

    voxels: DataFrame
    entities: DataFrame
    spacing: tuple[float, ...]
    config: RunConfig

    @property
    def dims(self) -> int:
        return len(self.spacing)

    @property
    def space(self) -> tuple[float, ...]:
        """The spacing with one for z where there is none."""
        return self.spacing if self.dims == 3 else (1.0, *self.spacing)

    @cached_property
    def of_kind(self) -> dict[str, DataFrame]:
        return {k: self.voxels.join(self.entities.where(F.col("entity_kind") == k).select("object_id", "entity"), ["object_id", "entity"], "left_semi") for k in ("label", "mask")}

    @cached_property
    def centre(self) -> DataFrame:
        """(object_id, cz, cy, cx) in micrometres: the object mask's centroid, else that of all that is segmented."""
        mask = self.config.object_mask
        if mask is None:
            found = morphology.segmented_centre(self.voxels, self.space)
            return found.select("object_id", *[F.col(f"object_center_{a}_um").alias(f"c{a}") for a in "zyx"])
        own = self.voxels.where(F.col("entity") == mask)
        return own.groupBy("object_id").agg(*[(F.avg(a) * s).alias(f"c{a}") for a, s in zip("zyx", self.space, strict=True)])

    @cached_property
    def field(self) -> DataFrame:
        """Distances of all foreground voxels to all entities; the object mask is met at what lies outside it."""
        mask = self.config.object_mask
        targets = self.voxels.where(F.col("entity") != mask) if mask else self.voxels
        targets = targets.select("object_id", F.col("entity").alias("target"), "z", "y", "x")
        if mask:
            targets = targets.unionByName(self.outside(mask))
        return distance.transform(targets, self.voxels, self.space, "process-distance")

    def outside(self, mask: str) -> DataFrame:
        """Voxels around the mask: of its box grown by one, those that are not in it (planes stay planes)."""
        inside = self.voxels.where(F.col("entity") == mask).select("object_id", "z", "y", "x")
        grow = {"z": 1 if self.dims == 3 else 0, "y": 1, "x": 1}
        box = inside.groupBy("object_id").agg(*[f(c).alias(f"{n}_{c}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max))])
        for c in "zyx":
            box = box.withColumn(c, F.explode(F.sequence(F.col(f"min_{c}") - grow[c], F.col(f"max_{c}") + grow[c])))
        return box.select("object_id", "z", "y", "x").join(unsent(inside), ["object_id", "z", "y", "x"], "left_anti").withColumn("target", F.lit(mask))

    @cached_property
    def shaped(self) -> DataFrame:
        """Size, boundary, roundness and aspect ratio of each label, named by dimension."""
        keys = extent_keys(self.dims)
        if self.dims == 3:
            return morphology.shapes(self.voxels, self.spacing)
        sized = self.voxels.groupBy(*INSTANCE).agg((F.count(F.lit(1)) * morphology.extent(self.spacing)).alias(keys["size"]))
        found = sized.join(morphology.boundary(self.voxels, self.spacing), INSTANCE).join(morphology.aspect_2d(self.voxels, self.spacing), INSTANCE)
        return found.withColumn(keys["roundness"], scalar.roundness(F.col(keys["size"]), F.col(keys["boundary"]), flat=True))

    def polar(self, places: DataFrame) -> DataFrame:
        """``places`` (…, z_um, y_um, x_um) with their direction from the centre of the object; 3-D columns only for volumes."""
        at = places.join(self.centre, "object_id", "left")
        off = [F.col(f"{a}_um") - F.col(f"c{a}") for a in "zyx"]
        found = scalar.direction(off[0] if self.dims == 3 else None, off[1], off[2])
        return at.withColumns(found).drop("cz", "cy", "cx")


class Measurer(Protocol):
    NAME: str
    DESCRIPTION: str
    COLUMN_DESCRIPTIONS: dict[str, str]

    def measure(self, batch: Batch) -> dict[str, DataFrame]: ...


class Morphology:
    """Per entity: total size, instances, and the shape of whole masks."""

    NAME, DESCRIPTION = "morphology", "size and shape of structures"
    COLUMN_DESCRIPTIONS = {"instance_count": "number of instances of the structure in the object", "sphericity": "boundary of the ball of equal size over the boundary", "polar_dist_um": "distance from the centre of the object"}
    ROLL_UP = ("instance_count",)

    def measure(self, batch: Batch) -> dict[str, DataFrame]:
        keys, by = extent_keys(batch.dims), ["object_id", "entity"]
        whole = batch.voxels.join(batch.entities, by)
        total = (F.count(F.lit(1)) * morphology.extent(batch.spacing)).alias(keys["total"])
        count = F.when(F.first("entity_kind") == "label", F.count_distinct("label")).cast("long").alias("instance_count")
        found = batch.entities.join(whole.groupBy(*by).agg(total, count), by, "left")
        found = found.withColumn("instance_count", F.when(F.col("entity_kind") == "label", F.coalesce("instance_count", F.lit(0)))).withColumn(keys["total"], F.coalesce(keys["total"], F.lit(0.0)))
        masks = batch.entities.where("entity_kind = 'mask'").select(*by)
        shaped = batch.shaped.join(masks, by, "left_semi").drop("label")
        places = morphology.centroids(batch.of_kind["mask"], batch.space).drop("label")
        polar = batch.polar(places).drop("z_um", "y_um", "x_um")
        out = found.join(shaped, by, "left").join(polar, by, "left")
        tables = {"entity": out.withColumnRenamed("entity", "entity_name")}
        rolled = report.roll_up(out, "object_id", list(self.ROLL_UP), [])
        extent = []
        if batch.config.object_mask:
            own = batch.voxels.where(F.col("entity") == batch.config.object_mask)
            extent = [own.groupBy("object_id").agg((F.count(F.lit(1)) * morphology.extent(batch.spacing)).alias(keys["object"]))]
        for df in [*extent, batch.centre.select("object_id", *[F.col(f"c{a}").alias(f"object_center_{a}_um") for a in "zyx"[3 - batch.dims :]])]:
            rolled = rolled.join(df, "object_id", "left")
        return tables | {"object": rolled}


class Instances:
    """Per instance: shape, direction, neighbours and distances; per target the baseline."""

    NAME, DESCRIPTION = "instances", "shape, place and distances of instances"
    COLUMN_DESCRIPTIONS = {
        "instance_distance_to_closest_same_type_um": "distance to the nearest instance of the same structure, by centroids", "distance_um": "least distance of the instance to the other structure",
        "baseline_median_um": "median distance of all points of the object to the structure", "instance_branches": "branches of the instance's centre line; empty if it was not traced",
    }

    def measure(self, batch: Batch) -> dict[str, DataFrame]:
        labels, config = batch.of_kind["label"], batch.config
        if labels.isEmpty():
            return {}
        by = ["object_id", "entity"]
        own = batch.shaped.join(batch.entities.where("entity_kind = 'label'").select(*by), by, "left_semi")
        places = stored(morphology.centroids(labels, batch.space), "process-centroids")
        polar = batch.polar(places)
        points = places.select(*INSTANCE, *[F.col(f"{a}_um").alias(a) for a in "zyx"])
        near = contacts.nearest_same_type(points, max(batch.spacing) * 16)
        found = own.join(polar.drop("z_um", "y_um", "x_um"), INSTANCE).join(near, INSTANCE, "left")
        if config.polarity_spread:
            found = found.join(polarity.spread(labels.select(*INSTANCE, "z", "y", "x"), batch.centre, batch.space, INSTANCE), INSTANCE, "left")
        if config.skeletons:
            lines, tips = self.lines(batch, labels.where(F.col("entity").isin(*config.skeletons)))
            found = found.join(lines, INSTANCE, "left")
        rename = {c: c if c.startswith("instance_") else f"instance_{c}" for c in found.columns if c not in INSTANCE}
        instance = found.withColumnsRenamed(rename).withColumnsRenamed({"entity": "instance_entity", "label": "instance_label"})
        met = labels.join(batch.field, ["object_id", "z", "y", "x"]).where(F.col("entity") != F.col("target"))
        gaps = distance.instance_distances(labels, batch.field)
        if config.histograms:
            gaps = gaps.join(distance.histograms(met, [*INSTANCE, "target"], ["object_id", "entity", "target"]), [*INSTANCE, "target"])
            gaps = gaps.withColumnsRenamed({"hist_min": "distance_hist_min_um", "hist_max": "distance_hist_max_um", "hist_counts": "distance_hist_counts"})
        else:
            gaps = gaps.drop("distance_mean_um")
        if config.skeletons:
            box = batch.voxels.groupBy("object_id").agg(*[f(a).alias(f"{a}{k}") for a in "zyx" for k, f in ((0, F.min), (1, F.max))])
            gaps = gaps.join(distance.tip_distances(tips, batch.field, box), [*INSTANCE, "target"], "left")
        gaps = gaps.withColumnsRenamed({"entity": "distance_entity", "label": "distance_label", "target": "distance_target"})
        tables = {"instance": instance, "distance": gaps}
        # the baseline: the object (or all that is segmented) without excluded structures, to each target that some instance is measured to
        region = batch.voxels.where(F.col("entity") == config.object_mask) if config.object_mask else batch.voxels
        measured = gaps.select("object_id", F.col("distance_target").alias("target")).distinct()
        field = batch.field.join(measured, ["object_id", "target"], "left_semi")
        gone = [*config.baseline_excluded]
        excluded = batch.voxels.where(F.col("entity").isin(gone)) if gone else batch.voxels.limit(0)
        base = distance.baseline(field, region, excluded).join(distance.baseline_histograms(field, region, excluded), ["object_id", "target"])
        tables["baseline"] = base.withColumn("baseline_excluded", F.lit(",".join(gone) or None)).withColumnRenamed("target", "baseline_target")
        if config.object_mask:
            inside = batch.field.where(F.col("target") == config.object_mask)
            centre = batch.voxels.groupBy(*by).agg(*[F.rint(F.avg(c)).cast("int").alias(c) for c in "zyx"])
            depth = centre.join(inside, ["object_id", "z", "y", "x"], "left").where(F.col("entity") != config.object_mask)
            tables["entity"] = depth.select("object_id", F.col("entity").alias("entity_name"), F.coalesce("distance_um", F.lit(0.0)).alias("polar_depth_um"))
        return tables


    def lines(self, batch: Batch, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(measures by instance, tips (…, z, y, x) in voxels) of centre lines; instances of more voxels than the cap have neither.

        Volumes are thinned in bricks, planes one instance at a time.
        """
        config = batch.config
        small = labels.groupBy(*INSTANCE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= config.max_skeleton_voxels)
        labels = stored(labels.join(small.drop("n"), INSTANCE, "left_semi"), "process-traced")
        if batch.dims == 2:
            lines = stored(skeleton.skeletons(labels, batch.spacing, config.skeleton_prune), "process-skeletons")
            tips = lines.select(*INSTANCE, F.explode("tips").alias("t")).select(*INSTANCE, *[F.element_at("t", k + 1).alias(a) for k, a in enumerate("zyx")])
            return lines.drop("tips", "skeleton"), tips
        vertices, edges = thinning.centre_lines(labels, batch.spacing, INSTANCE, config.skeleton_prune, name="process-lines")
        measures = stored(branches.metrics(edges, vertices, INSTANCE, "process-lines"), "process-skeletons")
        ends = branches.degrees(branches.darts(edges, INSTANCE), INSTANCE).where("degree = 1").select(*INSTANCE, "v")
        tips = vertices.join(ends, [*INSTANCE, "v"]).select(*INSTANCE, *[F.round(F.col(a) / s, 6).alias(a) for a, s in zip("zyx", batch.spacing, strict=True)])
        return measures, stored(tips, "process-tips")


class Contacts:
    """Pairs of instances of one structure whose voxels come near."""

    NAME, DESCRIPTION = "contacts", "touching instances"
    COLUMN_DESCRIPTIONS = {"contact_gap_um": "least distance between voxels of the two instances", "contact_count": "pairs of touching instances in the object"}

    def measure(self, batch: Batch) -> dict[str, DataFrame]:
        found = bricks.gaps(batch.of_kind["label"], batch.space if batch.dims == 3 else (1e9, *batch.spacing), batch.config.contact_um)
        pairs = stored(found, "process-contacts")
        counts = batch.entities.select("object_id").distinct().join(pairs.groupBy("object_id").agg(F.count(F.lit(1)).alias("contact_count")), "object_id", "left")
        rows_ = pairs.withColumnsRenamed({"entity": "contact_entity", "label_a": "contact_label_a", "label_b": "contact_label_b", "gap_um": "contact_gap_um"})
        return {"contact": rows_, "object": counts.withColumn("contact_count", F.coalesce("contact_count", F.lit(0)))}


REGISTRY: tuple[Measurer, ...] = (Morphology(), Instances(), Contacts())


def chosen(exclude: tuple[str, ...] = (), registry: tuple[Measurer, ...] = REGISTRY) -> list[Measurer]:
    """All measurers but those named; a name that none has is an error."""
    unknown = set(exclude) - {m.NAME for m in registry}
    if unknown:
        raise ValueError(f"no measurer is called {', '.join(sorted(unknown))}")
    return [m for m in registry if m.NAME not in exclude]


def descriptions(measurers: list[Measurer]) -> dict[str, str]:
    return {k: v for m in measurers for k, v in m.COLUMN_DESCRIPTIONS.items()}


def merged(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of several measurers of one batch: object and entity tables side by side, deep ones as they are."""
    out: dict[str, DataFrame] = {}
    for part in parts:
        for kind, df in part.items():
            if kind not in out:
                out[kind] = df
            elif kind == "object":
                out[kind] = out[kind].join(df, "object_id", "left")
            elif kind == "entity":
                out[kind] = rows.with_extras(out[kind], df)
            else:
                raise ValueError(f"two measurers give {kind} rows")
    return out
