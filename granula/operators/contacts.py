"""Contacts, neighbours and clusters of instances with coordinates.

Instances are (object_id, entity, label, z, y, x); all joins are equi-joins on a grid cell,
never all pairs.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import stored, unsent
from granula.operators.graph import components

AXES = ("z", "y", "x")
KEYS = ("object_id", "entity")


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / size) for a in AXES})


def band_join(left: DataFrame, right: DataFrame, reach: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one object and entity within ``reach``: (object_id, entity, label_a, label_b, gap_um), and the columns ``carry`` of both as name_a, name_b.

    The left side is dealt to its 27 neighbouring cells, the right side stands in its own.
    """
    both = lambda p: [F.col(c).alias(f"{c}_{p}") for c in carry]
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    a = _cells(left, reach).withColumn("s", F.explode(steps))
    a = a.select(*KEYS, F.col("label").alias("label_a"), *both("a"), *[F.col(x).alias(f"a{x}") for x in AXES], *[(F.col(f"c{x}") + F.col(f"s.d{x}")).alias(f"c{x}") for x in AXES])
    b = _cells(right, reach).select(*KEYS, F.col("label").alias("label_b"), *both("b"), *[F.col(x).alias(f"b{x}") for x in AXES], *[f"c{x}" for x in AXES])
    gap = F.sqrt(sum((F.col(f"a{x}") - F.col(f"b{x}")) ** 2 for x in AXES))
    met = a.join(unsent(b), [*KEYS, *[f"c{x}" for x in AXES]])
    return met.select(*KEYS, "label_a", "label_b", *[f"{c}_{p}" for c in carry for p in "ab"], gap.alias("gap_um")).where(F.col("gap_um") <= reach)


def contact_pairs(instances: DataFrame, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Touching pairs, label_a < label_b, with the least gap (several points of an instance may be given).

    Pairs grow with the square of the density. Those of instances with one point come once from
    the join and go on without a shuffle; only those with more points are grouped. ``carry``
    names columns that all points of an instance share.
    """
    counted = instances.withColumn("__points", F.count(F.lit(1)).over(W.partitionBy(*KEYS, "label")))
    one, more = counted.where("__points = 1"), counted.where("__points > 1")
    pair = [*KEYS, "label_a", "label_b", *[f"{c}_{p}" for c in carry for p in "ab"]]
    once = band_join(one, one, threshold, carry).where("label_a < label_b").select(*pair, "gap_um")
    met = band_join(more, instances, threshold, carry).where("label_a <> label_b")
    low = F.col("label_a") < F.col("label_b")
    turned = lambda c: [F.when(low, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a"), F.when(low, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b")]
    met = met.select(*KEYS, *[x for c in ("label", *carry) for x in turned(c)], "gap_um")
    return once.unionByName(met.groupBy(*pair).agg(F.min("gap_um").alias("gap_um")))


def nearest_same_type(instances: DataFrame, cell: float, name: str = "nearest") -> DataFrame:
    """Distance to the closest other instance of the entity; null for a lone one.

    A neighbour within one cell width is certain from the 27 cells around. Instances without
    one go on with cells twice as wide; few are left by then, and all find one in the end.
    """
    key = [*KEYS, "label"]
    result = "instance_distance_to_closest_same_type_um"
    placed = stored(instances.select(*key, *AXES), f"{name}-all")
    several = placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    lone = placed.join(several.where("n = 1"), list(KEYS), "left_semi").select(*key, F.lit(None).cast("double").alias(result))
    rest, found = placed.join(several.where("n > 1"), list(KEYS), "left_semi"), [lone]
    while True:
        near = band_join(rest, placed, cell).where("label_a <> label_b").groupBy(*KEYS, F.col("label_a").alias("label")).agg(F.min("gap_um").alias(result))
        near = stored(near, f"{name}-near")
        found.append(near.select(*key, result))
        rest = stored(rest.join(near, key, "left_anti"), f"{name}-rest")
        if rest.isEmpty():
            return reduce(DataFrame.union, found)
        cell *= 2


def clusters(instances: DataFrame, contacts: DataFrame, reach: float, name: str = "clusters") -> DataFrame:
    """(object_id, entity, label, cluster) over contacts with gap <= reach; each instance is seeded, cluster is its least label."""
    node = lambda c: F.struct(*KEYS, F.col(c).alias("label"))
    links = contacts.where(F.col("gap_um") <= reach).select(node("label_a").alias("a"), node("label_b").alias("b"))
    found = components(instances.select(node("label").alias("node")), links, name)
    return found.select("node.*", F.col("root.label").alias("cluster"))


def near_clusters(instances: DataFrame, reach: float, name: str = "clusters") -> DataFrame:
    """clusters() over all pairs of points within ``reach``, without the pairs.

    Points of one fine cell, and of cells that touch, are always within reach (cells are a
    little narrower than reach / sqrt(12)), so components are found over cells. Only cells of
    different components that lie near meet point by point: outliers and the rims of clusters,
    few where points are dense. A second search over those components settles the rest. Each
    instance has one point; one without a finite coordinate is near nothing.
    """
    fine = reach / math.sqrt(12) * (1 - 1e-9)
    names = [f"c{a}" for a in AXES]
    at = [*KEYS, *names]
    placed = stored(_cells(instances.select(*KEYS, "label", *AXES), fine), f"{name}-cells")
    finite = reduce(Column.__and__, [F.col(a).isNotNull() & (F.abs(a) < F.lit(math.inf)) for a in AXES])  # NaN is above all
    whole = placed.where(finite)
    cell = lambda *cols: F.struct(*KEYS, *cols)
    cells = stored(whole.select(*at).distinct(), f"{name}-distinct")

    def shifted(rows: DataFrame, steps: list[tuple[int, ...]], more: list[str]) -> DataFrame:
        moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in steps])
        rows = rows.withColumn("s", F.explode(moves))
        return rows.select(*KEYS, *[F.col(c).alias(f"from_{c}") for c in names], *[(F.col(f"c{a}") + F.col(f"s.d{a}")).alias(f"c{a}") for a in AXES], *more)

    half = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    touching = shifted(cells, half, []).join(unsent(cells), at)
    links = touching.select(cell(*[F.col(f"from_{c}").alias(c) for c in names]).alias("a"), cell(*names).alias("b"))
    parts = stored(components(cells.select(cell(*names).alias("node")), links, name).select("node.*", "root"), f"{name}-parts")
    # cells that do not touch, whose nearest corners are within reach; one of two unlike cells is outside the largest component
    apart = lambda o: math.sqrt(sum(max(0, abs(d) - 1) ** 2 for d in o)) * fine
    far = [o for o in product(range(-5, 6), repeat=3) if max(map(abs, o)) > 1 and apart(o) <= reach]
    sizes = parts.groupBy(*KEYS, "root").agg(F.count(F.lit(1)).alias("cells"))
    largest = sizes.groupBy(*KEYS).agg(F.max(F.struct("cells", "root")).alias("most")).select(F.col("most.root").alias("root"))
    small = stored(parts.join(unsent(largest), "root", "left_anti"), f"{name}-small")
    other = parts.withColumnRenamed("root", "other")
    unlike = shifted(small, far, ["root"]).join(unsent(other), at).where(F.col("root") != F.col("other"))
    unlike = stored(unlike, f"{name}-unlike")
    ends = lambda p, cols: whole.select(*KEYS, *[F.col(c).alias(n) for c, n in zip(names, cols, strict=True)], *[F.col(a).alias(f"{p}{a}") for a in AXES]).distinct()
    met = unlike.join(unsent(ends("p", [f"from_{c}" for c in names])), [*KEYS, *[f"from_{c}" for c in names]]).join(unsent(ends("q", names)), at)
    gap = F.sqrt(sum((F.col(f"p{a}") - F.col(f"q{a}")) ** 2 for a in AXES))
    joined = met.where(gap <= reach).select(F.col("root").alias("a"), F.col("other").alias("b")).distinct()
    above = components(parts.select(F.col("root").alias("node")).distinct(), joined, f"{name}-above").select(F.col("node").alias("root"), F.col("root").alias("top"))
    member = stored(whole.join(unsent(parts), at).join(unsent(above), "root").select(*KEYS, "label", "top"), f"{name}-members")
    least = member.groupBy("top").agg(F.min("label").alias("cluster"))
    lone = placed.where(~finite).select(*KEYS, "label", F.col("label").alias("cluster"))
    return member.join(unsent(least), "top").select(*KEYS, "label", "cluster").unionByName(lone)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Clusters of two or more."""
    return members.groupBy(*KEYS, "cluster").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def cluster_reach(members: DataFrame, distances: DataFrame) -> DataFrame:
    """Size and least member distance of each cluster of two or more; ``distances`` has (object_id, entity, label, reach)."""
    found = members.join(distances, [*KEYS, "label"], "left").groupBy(*KEYS, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("reach"))
    return found.where("n >= 2")


def cluster_chance(reached: DataFrame, distances: DataFrame) -> DataFrame:
    """Percent of random groups of equal size whose least distance is greater, ties half: from log binomials.

    100 (C(g, k) + (C(ge, k) - C(g, k)) / 2) / C(n, k), with g and ge the instances of the
    object and entity that lie farther, or as far or farther.
    """
    ranked = distances.where("reach is not null").groupBy(*KEYS, "reach").agg(F.count(F.lit(1)).alias("m"))
    whole = W.partitionBy(*KEYS).orderBy(F.col("reach").desc())
    tail = ranked.withColumn("ge", F.sum("m").over(whole.rowsBetween(W.unboundedPreceding, 0))).withColumn("n_all", F.sum("m").over(W.partitionBy(*KEYS)))
    tail = tail.select(*KEYS, "reach", "ge", (F.col("ge") - F.col("m")).alias("g"), "n_all")
    # C(a, k) / C(n, k) as a sum of logarithms over k factors
    ratio = lambda a: F.when(a < F.col("n"), 0.0).otherwise(F.exp(F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(0.0), lambda s, i: s + F.ln((a - i) / (F.col("n_all") - i)))))
    rows = reached.where("reach is not null").join(tail, [*KEYS, "reach"])
    greater = ratio(F.col("g"))
    return rows.select(*KEYS, "cluster", "n", "reach", (100 * (greater + (ratio(F.col("ge")) - greater) / 2)).alias("chance_percent"))


def sorted_contacts(contacts: DataFrame) -> DataFrame:
    """In the order of a report: by object, entity, labels and gap."""
    return contacts.orderBy(*KEYS, "label_a", "label_b", "gap_um")
