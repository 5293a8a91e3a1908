"""Which folders are objects, which file is their source and which entities they hold.

Works on a listing (path, length) of files, so nothing but metadata is read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions import scalar
from granula.sources.images import SUFFIXES

#: Sub-folders whose images are entities whatever their names say.
ENTITY_FOLDERS = ("segmentations", "segmentation", "masks", "labels")
_ENDING = "(?i)(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below ``root`` without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def prefix_scores(files: DataFrame, folder: str = "dir", stem: str = "stem") -> DataFrame:
    """(folder, stem, copies, score): for each name of a folder, the characters that it shares from the start with every other file there, added up.

    Each prefix of a name is a row; the files of a folder that begin with it, less the one
    itself, add one each. Rows grow with the characters of the names and not with the pairs
    of files; equal names are counted first. Names without a character score 0.
    """
    names = files.groupBy(folder, stem).agg(F.count(F.lit(1)).alias("copies"))
    begin = F.transform(F.sequence(F.lit(1), F.length(stem)), lambda k: F.substr(F.col(stem), F.lit(1), k))
    each = names.where(F.length(stem) > 0).select(folder, stem, "copies", F.explode(begin).alias("__prefix"))
    shared = each.groupBy(folder, "__prefix").agg(F.sum("copies").alias("__n")).where("__n > 1")
    summed = each.join(shared, [folder, "__prefix"]).groupBy(folder, stem).agg(F.sum(F.col("__n") - 1).alias("score"))
    return names.join(summed, [folder, stem], "left").select(folder, stem, "copies", F.coalesce("score", F.lit(0).cast("long")).alias("score"))


def discovered(files: DataFrame) -> DataFrame:
    """(object_dir, path, role, entity_name, entity_kind, reason) of every image.

    role: source, entity or rejected. The source is the image without a kind suffix that
    shares the longest prefixes with the others, then the largest, then the first by path.
    Entities are named by what follows the prefix they share with it; of two with one kind
    and name the later path is rejected, as is a name that comes out empty.
    """
    image = files.where(F.regexp_extract("path", _ENDING, 1) != "")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    folder = F.lower(F.substring_index(parent, "/", -1))
    nested = folder.isin(*ENTITY_FOLDERS)
    rows = image.select(
        "path", "length", nested.alias("nested"), F.when(nested, F.regexp_extract(parent, "^(.*)/[^/]*$", 1)).otherwise(parent).alias("object_dir"),
        F.regexp_replace(F.substring_index("path", "/", -1), _ENDING, "").alias("stem"),
    )
    body, kind = scalar.kind_suffix(F.col("stem"))
    rows = rows.withColumn("body", body).withColumn("kind", F.when(kind.isNull() & F.col("nested"), "auto").otherwise(kind))
    bare = rows.where("kind is null").select("object_dir", "path", "length", "stem")
    score = bare.join(prefix_scores(rows, "object_dir").drop("copies"), ["object_dir", "stem"])
    best = W.partitionBy("object_dir").orderBy(F.desc("score"), F.desc("length"), "path")
    source = score.withColumn("k", F.row_number().over(best)).where("k = 1").select("object_dir", F.col("path").alias("source_path"), F.col("stem").alias("source_stem"))
    joined = rows.join(source, "object_dir", "left")
    shared = scalar.whole_prefix(F.col("body"), scalar.shared_prefix(F.col("body"), F.col("source_stem")), F.col("source_stem"))
    n = F.when(F.col("nested"), F.lit(0)).otherwise(F.coalesce(shared, F.lit(0)))
    named = joined.withColumn("n", n).withColumn("entity_name", F.nullif(scalar.normal_name(F.expr("substring(body, n + 1)")), F.lit("")))
    twin = F.row_number().over(W.partitionBy("object_dir", "kind", "entity_name").orderBy("path"))
    is_source = F.col("path") == F.col("source_path")
    reason = (
        F.when(is_source, None).when(F.col("source_path").isNull(), "no source image").when(F.col("kind").isNull(), "neither source nor entity")
        .when(F.col("entity_name").isNull(), "no name left").when(twin > 1, "same name twice")
    )
    judged = named.withColumn("reason", reason)
    role = F.when(F.col("path") == F.col("source_path"), "source").when(F.col("reason").isNull(), "entity").otherwise("rejected")
    return judged.select("object_dir", "path", role.alias("role"), F.when(role == "entity", F.col("entity_name")).alias("entity_name"), F.when(role == "entity", F.col("kind")).alias("entity_kind"), "reason")


def manifest(text: str) -> dict:
    """A folder's source.json: where its arrays are, which entities they hold and of which kind; missing keys are named.

    Entities are names with an array, or with an array and a kind (label by default); ``masks``
    adds entities that are masks. The result has store, scale, crop, source, entities as
    (name, kind, array), object_mask and voxel_size_um.
    """
    said = json.loads(text)
    missing = [k for k in ("store", "entities") if k not in said]
    if missing:
        raise ValueError(f"source.json lacks {', '.join(missing)}")
    entities = []
    for kind, part in (("label", said["entities"]), ("mask", said.get("masks") or {})):
        for name, value in part.items():
            array = value if isinstance(value, str) else (value or {}).get("array")
            if not array:
                raise ValueError(f"source.json: entity {name} lacks array")
            entities.append((name, kind if isinstance(value, str) else value.get("kind", kind), array))
    size = said.get("voxel_size_um")
    if size is not None and (len(size) not in (2, 3) or any(not v > 0 for v in size)):
        raise ValueError("source.json: voxel_size_um has two or three positive numbers")
    return {
        "store": said["store"], "scale": said.get("scale"), "crop": crop_box(said.get("crop")), "source": said.get("source"), "entities": entities,
        "object_mask": said.get("object_mask"), "voxel_size_um": size, "derived": said.get("derived"),
    }


def object_dirs(found: DataFrame) -> DataFrame:
    """Folders with a source and at least one entity, sorted."""
    has = lambda role: F.max(F.when(F.col("role") == role, 1).otherwise(0)) == 1
    return found.groupBy("object_dir").agg(has("source").alias("s"), has("entity").alias("e")).where("s and e").select("object_dir").orderBy("object_dir")


def crop_box(text: str | None) -> list[tuple[int | None, int | None]] | None:
    """``lo:hi,lo:hi,...``; nothing is the whole array."""
    if not text:
        return None
    out = []
    for part in text.split(","):
        if ":" not in part:
            raise ValueError(f"{part!r} has no colon")
        lo, hi = part.split(":", 1)
        out.append((int(lo) if lo.strip() else None, int(hi) if hi.strip() else None))
    return out


def boxed(voxels: DataFrame, box: list[tuple[int | None, int | None]] | None) -> DataFrame:
    """Voxels within a crop box, as a pushed-down filter."""
    for axis, (lo, hi) in zip("zyx", box or [], strict=False):
        voxels = voxels.where(F.lit(True) if lo is None else F.col(axis) >= lo).where(F.lit(True) if hi is None else F.col(axis) < hi)
    return voxels
