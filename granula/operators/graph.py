"""Components of link tables and of voxel neighbourhoods."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import stored, unsent


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for all ``nodes`` (node) over undirected ``links`` (a, b): the least node reachable.

    Rounds of the least neighbouring label and a jump to that label's label; each round is
    written to the shared folder. Minima are combined before the shuffle, so hubs are safe.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct(), f"{name}-edges")
    labels = nodes.select("node", F.col("node").alias("root"))
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        near = labels.join(unsent(heard), F.col("node") == F.col("n"), "left").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        far = labels.select(F.col("node").alias("n"), F.col("root").alias("m"))
        after = stored(near.join(unsent(far), F.col("root") == F.col("n")).select("node", "was", F.least("root", "m").alias("root")), f"{name}-labels")
        if after.where(F.col("was") != F.col("root")).isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def neighbour_offsets(dims: int = 3, full: bool = True, half: bool = False) -> list[tuple[int, ...]]:
    """Offsets to the neighbours of a voxel: all, or those over faces; half: one of each direction."""
    found = [o for o in product((-1, 0, 1), repeat=dims) if any(o) and (full or sum(map(abs, o)) == 1)]
    return [o for o in found if o > (0,) * dims] if half else found


def voxel_components(voxels: DataFrame, full: bool = True, name: str = "voxels") -> DataFrame:
    """``voxels`` (object_id, entity, z, y, x) with ``component``: 1, 2, ... by the first voxel of each, per entity.

    Bricks number their own parts; only the parts that touch over brick borders are links,
    so the rounds of the component search run over parts and not over voxels.
    """
    from granula.operators.bricks import local_components

    at = ["object_id", "entity", "z", "y", "x"]
    local = stored(local_components(voxels.select(*at).distinct(), neighbour_offsets(3, full, half=True)), f"{name}-local")
    node = lambda p: F.struct("object_id", "entity", p.alias("part"))
    own = local.where("own").drop("own")
    touched = local.where(~F.col("own")).select(*at, F.col("part").alias("other"))
    links = touched.join(own, at).select(node(F.col("part")).alias("a"), node(F.col("other")).alias("b"))
    parts = own.select(node(F.col("part")).alias("node")).distinct()
    roots = components(parts, links, name).select("node", "root")
    # a root is the least part of its component and named by its first voxel
    order = W.partitionBy("root.object_id", "root.entity").orderBy("root.part")
    numbered = roots.select("root").distinct().withColumn("component", F.row_number().over(order))
    numbers = roots.join(numbered, "root").select(F.col("node.object_id").alias("object_id"), F.col("node.entity").alias("entity"), F.col("node.part").alias("part"), "component")
    return own.join(unsent(numbers), ["object_id", "entity", "part"]).select(*at, "component")


def promoted(voxels: DataFrame, kinds: DataFrame, mask: str | None = None, auto: bool = False, name: str = "parts") -> tuple[DataFrame, DataFrame]:
    """``voxels`` (object_id, entity, z, y, x, label) and ``kinds`` (object_id, entity, entity_kind, declared) after their masks are taken apart.

    A label entity that a manifest declares, but whose volume has no second id, is numbered by its
    components, whatever their number. With ``auto`` every mask of more than one component but
    the object mask becomes a label entity, as does a label volume with one id. Without it a
    mask stays one mask however many pieces it has. Full connectivity; counted on the voxels
    given, so clip them first. Masks that stay have the label 1.
    """
    keys = ["object_id", "entity"]
    top = voxels.groupBy(*keys).agg(F.max("label").alias("top"))
    known = stored(kinds.join(top, keys, "left"), f"{name}-kinds")
    one = (F.col("entity_kind") == "mask") | (F.coalesce("top", F.lit(0)) <= 1)
    declared = F.coalesce("declared", F.lit(False)) & (F.col("entity_kind") == "label") & one
    free = F.lit(auto) & one & ((F.col("entity") != mask) if mask is not None else F.lit(True))
    asked = known.where(declared | free).select(*keys, declared.alias("always"))
    parts = voxel_components(voxels.join(asked, keys, "left_semi").select(*keys, "z", "y", "x"), name=name)
    several = parts.groupBy(*keys).agg(F.max("component").alias("parts")).join(asked, keys).where((F.col("parts") > 1) | F.col("always")).select(*keys)
    several = stored(several, f"{name}-several")
    split = parts.join(several, keys, "left_semi").select(*keys, "z", "y", "x", F.col("component").cast("long").alias("label"))
    rest = voxels.join(several, keys, "left_anti").join(known.select(*keys, "entity_kind"), keys)
    rest = rest.select(*keys, "z", "y", "x", F.when(F.col("entity_kind") == "mask", F.lit(1).cast("long")).otherwise(F.col("label").cast("long")).alias("label"))
    out = known.join(several.withColumn("more", F.lit(True)), keys, "left").select(*keys, F.when(F.col("more"), "label").otherwise(F.col("entity_kind")).alias("entity_kind"))
    return rest.unionByName(split), out
