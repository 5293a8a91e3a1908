"""Queries over generated voxels, with SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.storage import spread, stored, unsent
from granula.operators import branches, bricks, distance, flood, geometry, graph, morphology, polarity, thinning, volumes
from granula.operators.graph import neighbour_offsets
from granula.process import sql as sql_measure
from granula.sources import voxels as source

S = source.SPACING
SZ, SY, SX = S
VX = SZ * SY * SX
V = f"WITH RECURSIVE {source.sql()}"
MASKS = ("cell", "nucleus")


def vox(spark, sf_dir):
    """One object for each supplier, so the voxels grow with the scale factor."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    objects = suppliers.select(F.concat(F.lit("obj"), "s_suppkey").alias("object_id"), F.col("s_suppkey").alias("k"))
    return source.generated(spread(objects, "object_id"))


def rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _field(spark, sf_dir, only=None):
    """Distances from all voxels of entities to the boundary of the cell, the nucleus and the mitos, or to one of them."""
    v = stored(vox(spark, sf_dir), "voxels")  # read several times
    targets = v.where("entity <> 'cell'").select("object_id", F.col("entity").alias("target"), "z", "y", "x")
    targets = targets.unionByName(distance.complement(v, "cell"))
    return v, distance.transform(targets.where(F.col("target") == only) if only else targets, v, S)


def _targets(v, only=None):
    """The nucleus, the mitochondria and what lies around the cell, or one of them."""
    targets = v.where("entity <> 'cell'").select("object_id", F.col("entity").alias("target"), "z", "y", "x").unionByName(distance.complement(v, "cell"))
    return targets.where(F.col("target") == only) if only else targets


def _region(v):
    """The voxels of the cell outside its nucleus."""
    at = ["object_id", "z", "y", "x"]
    return v.where("entity = 'cell'").select(*at).join(unsent(v.where("entity = 'nucleus'").select(*at)), at, "left_anti")


def _near(spark, sf_dir, only=None):
    """Distances of the voxels of mitochondria, with their labels, to the other targets."""
    v = stored(vox(spark, sf_dir), "voxels")
    mito = v.where("entity = 'mito'").select("object_id", "z", "y", "x", "entity", "label")
    return distance.transform(_targets(v, only).where("target <> 'mito'"), mito, S, carry=["entity", "label"])


def _dist_sql() -> str:
    return f"""
inside AS (SELECT object_id, z, y, x FROM vox WHERE entity = 'cell'),
box AS (SELECT object_id, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM inside GROUP BY 1),
tgt AS (SELECT object_id, entity AS target, z, y, x FROM vox WHERE entity <> 'cell'
  UNION ALL SELECT g.object_id, 'cell', g.z, g.y, g.x FROM g JOIN box b ON b.object_id = g.object_id AND g.z BETWEEN z0 AND z1 AND g.y BETWEEN y0 AND y1 AND g.x BETWEEN x0 AND x1
    WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.object_id = g.object_id AND i.z = g.z AND i.y = g.y AND i.x = g.x)),
pts AS (SELECT DISTINCT object_id, z, y, x FROM vox),
field AS (SELECT p.object_id, target, p.z, p.y, p.x, sqrt(min(power((p.z - t.z) * {SZ}::DOUBLE, 2) + power((p.y - t.y) * {SY}::DOUBLE, 2) + power((p.x - t.x) * {SX}::DOUBLE, 2))) AS distance_um
  FROM pts p JOIN tgt t ON t.object_id = p.object_id GROUP BY ALL)"""


def instance_size(spark, sf_dir):
    return rounded(morphology.instance_sizes(vox(spark, sf_dir), S))


def instance_centroid(spark, sf_dir):
    return rounded(morphology.centroids(vox(spark, sf_dir), S))


def entity_total(spark, sf_dir):
    rows = morphology.entity_rows(vox(spark, sf_dir), S, MASKS)
    return rounded(rows.withColumn("instance_count", F.col("instance_count").cast("double")))


def object_extent(spark, sf_dir):
    return rounded(morphology.object_extent(vox(spark, sf_dir), "cell", S))


def segmented_centre(spark, sf_dir):
    return rounded(morphology.segmented_centre(vox(spark, sf_dir), S))


def instance_aspect(spark, sf_dir):
    return rounded(morphology.aspect_2d(vox(spark, sf_dir).where("z = 4"), (SY, SX)), 5)


def instance_aspect_3d(spark, sf_dir):
    return rounded(morphology.aspect_3d(vox(spark, sf_dir), S), 5)


def instance_boundary(spark, sf_dir):
    return rounded(morphology.boundary(vox(spark, sf_dir), S))


def instance_perimeter(spark, sf_dir):
    return rounded(morphology.boundary(vox(spark, sf_dir).where("z = 4"), (SY, SX)))


def instance_roundness(spark, sf_dir):
    return rounded(morphology.roundness(vox(spark, sf_dir), S).select("object_id", "entity", "label", "sphericity"))


def bounding_box(spark, sf_dir):
    return rounded(morphology.bounding_boxes(vox(spark, sf_dir)))


def clip_to_mask(spark, sf_dir):
    return morphology.clipped(vox(spark, sf_dir), "cell")


def crop_to_bbox(spark, sf_dir):
    return morphology.cropped(vox(spark, sf_dir), "nucleus")


def label_map_split(spark, sf_dir):
    return morphology.split_labels(vox(spark, sf_dir), {1: "left", 3: "right"}, "mito")


def auto_kind(spark, sf_dir):
    return morphology.auto_kind(vox(spark, sf_dir), "cell")


def channel_order(spark, sf_dir):
    return morphology.channel_order(morphology.auto_kind(vox(spark, sf_dir), "cell"), "cell")


def edge_touch(spark, sf_dir):
    return morphology.edge_touch(vox(spark, sf_dir), source.SHAPE)


def distance_transform(spark, sf_dir):
    return rounded(_field(spark, sf_dir)[1])


def distance_min(spark, sf_dir):
    return rounded(distance.nearest(_near(spark, sf_dir)))


def distance_to_boundary(spark, sf_dir):
    return rounded(distance.nearest(_near(spark, sf_dir, "cell")).select("object_id", "label", "distance_um"))


def distance_histogram(spark, sf_dir):
    met = _near(spark, sf_dir).withColumn("distance_um", F.round("distance_um", 9))
    return rounded(distance.histograms(met, ["object_id", "entity", "label", "target"], ["object_id", "entity", "target"]))


def distance_wide(spark, sf_dir):
    found = distance_min(spark, sf_dir)
    return found.groupBy("object_id", "entity", "label").pivot("target", ["cell", "nucleus"]).agg(F.first("distance_um")).withColumnsRenamed({"cell": "distance_to_cell_um", "nucleus": "distance_to_nucleus_um"})


def baseline_stats(spark, sf_dir):
    v = stored(vox(spark, sf_dir), "voxels")
    field = distance.transform(_targets(v), _region(v), S).withColumn("distance_um", F.round("distance_um", 9))
    return rounded(distance.baseline_of(field))


def polar_depth(spark, sf_dir):
    v = stored(vox(spark, sf_dir), "voxels")
    at = ["object_id", "z", "y", "x"]
    centre = v.where("entity <> 'cell'").groupBy("object_id", "entity").agg(*[F.rint(F.avg(c)).cast("int").alias(c) for c in "zyx"])
    depth = distance.transform(_targets(v, "cell"), centre.join(v.select(*at), at, "left_semi"), S, carry=["entity"])
    met = centre.join(depth.select("object_id", "entity", "distance_um"), ["object_id", "entity"], "left")
    return rounded(met.select("object_id", "entity", F.coalesce("distance_um", F.lit(0.0)).alias("polar_depth_um")))


def polar_spread(spark, sf_dir):
    v = vox(spark, sf_dir)
    centre = v.where("entity = 'cell'").groupBy("object_id").agg(*[(F.avg(c) * s).alias(f"c{c}") for c, s in zip("zyx", S, strict=True)])
    return rounded(polarity.spread(v.where("entity = 'mito'").select("object_id", "label", "z", "y", "x"), centre, S, ["object_id", "label"]), 5)


def voxel_components(spark, sf_dir):
    return graph.voxel_components(vox(spark, sf_dir).where("entity = 'mito'").withColumn("label", F.lit(1)))


def promote_masks(spark, sf_dir):
    """Components of the mito mask, read as one mask: more than one makes it a label entity."""
    found = voxel_components(spark, sf_dir).groupBy("object_id", "entity").agg(F.count_distinct("component").alias("n_components"))
    return found.withColumn("entity_kind", F.when(F.col("n_components") > 1, "label").otherwise("mask"))


def dilation(spark, sf_dir):
    return volumes.dilated(vox(spark, sf_dir).where("entity = 'mito'").select("object_id", "entity", "z", "y", "x"))


def _seeds(v):
    return v.where("entity = 'mito'").select("object_id", "z", "y", "x", F.col("label").alias("seed"))


def seeded_flood(spark, sf_dir):
    """Each voxel of the cell with the mitochondrion that reaches it in the fewest steps over faces, and those steps."""
    v = stored(vox(spark, sf_dir), "flood-voxels")
    space = v.where("entity = 'cell'").select("object_id", "z", "y", "x", F.lit(0.0).alias("height"))
    return flood.flooded(space, _seeds(v), name="seeded").select("object_id", "z", "y", "x", "steps", "seed")


def cell_basins(spark, sf_dir):
    """The cell parted among its mitochondria by a flood that rises from the deepest voxels."""
    v = stored(vox(spark, sf_dir), "basin-voxels")
    cell = v.where("entity = 'cell'").select("object_id", "z", "y", "x")
    depth = distance.transform(distance.complement(v, "cell"), cell, S, "basin-depth").select("object_id", "z", "y", "x", (-F.round("distance_um", 9)).alias("height"))
    return flood.flooded(depth, _seeds(v), name="basins").groupBy("object_id", "seed").agg(F.count(F.lit(1)).alias("voxels"), F.max("steps").alias("steps"))


def centre_lines(spark, sf_dir):
    """Branches, length and tortuosity of every instance's centre line, thinned in bricks."""
    v = vox(spark, sf_dir).where("entity <> 'cell'")
    vertices, edges = thinning.centre_lines(v, S)
    return rounded(branches.metrics(edges, vertices))


def sql_measures(spark, sf_dir):
    """The table function ``measure`` over all voxels, for two measures by name."""
    sql_measure.register(spark, S)
    sql_measure.packed(vox(spark, sf_dir)).createOrReplaceTempView("measured_voxels")
    return rounded(spark.sql("SELECT * FROM measure(TABLE(SELECT object_id, entity, z, y, x, label FROM measured_voxels) PARTITION BY (object_id), 'morphology, boxes')"))


def surface_mesh(spark, sf_dir):
    """Mesh payloads of all instances."""
    return geometry.surfaces(vox(spark, sf_dir), S)


def baseline_histogram(spark, sf_dir):
    """The 128 stored bins of the chance distances to the cell boundary."""
    v = stored(vox(spark, sf_dir), "voxels")
    field = distance.transform(_targets(v, "cell"), _region(v), S).withColumn("distance_um", F.round("distance_um", 9))
    return rounded(distance.baseline_histograms_of(field))


def tip_distance(spark, sf_dir):
    """Distances of the corners of each instance's box, taken as its tips, to the other targets."""
    v = stored(vox(spark, sf_dir), "voxels")
    box = morphology.bounding_boxes(v.where("entity = 'mito'"))
    tips = box.select("object_id", "entity", "label", F.explode(F.array(*[F.struct(*[(F.col(f"{k}_{a}") + d).alias(a) for a in "zyx"]) for k, d in (("min", 0.25), ("max", -0.25))])).alias("t")).select("object_id", "entity", "label", "t.*")
    whole = v.groupBy("object_id").agg(*[f(a).alias(f"{a}{k}") for a in "zyx" for k, f in ((0, F.min), (1, F.max))])
    at = ["object_id", "z", "y", "x"]
    ends = distance.tip_voxels(tips, whole).join(v.select(*at), at, "left_semi")
    return rounded(distance.tip_distances_of(distance.transform(_targets(v).where("target <> 'mito'"), ends, S, carry=["entity", "label"])))


def geometry_rows(spark, sf_dir):
    """Rows of the geometry file without payloads; which instances get a mesh or an ellipsoid is in surface_kind."""
    v = vox(spark, sf_dir)
    shaped = morphology.shapes(v, S)
    kinds = v.select("object_id", "entity").distinct().withColumn("entity_kind", F.when(F.col("entity") == "mito", "label").otherwise("mask"))
    pairs = bricks.gaps(v.where("entity = 'mito'"), S, 0.16)
    found = geometry.geometry_rows(v, kinds, S, shaped, pairs)
    return rounded(found.select("object_id", "row_type", "entity_name", "label", "voxels", "volume_um3", "sphericity", "fill_ratio", F.col("surface").isNotNull().alias("has_surface"), "entity_a", "label_a", "label_b", "gap_um"), 5)


def flagship(spark, sf_dir):
    """Median distance of instances to the boundary of their object against chance, by group."""
    v = stored(vox(spark, sf_dir), "voxels")
    at = ["object_id", "z", "y", "x"]
    points = v.where("entity = 'mito'").select(*at, "entity", "label").unionByName(_region(v).select(*at, F.lit("").alias("entity"), F.lit(0).alias("label")))
    field = distance.transform(_targets(v, "cell"), points, S, carry=["entity", "label"])
    own = distance.nearest(field.where("entity <> ''")).groupBy("object_id", "entity").agg(F.median("distance_um").alias("median_um"))
    chance = distance.baseline_of(field.where("entity = ''")).select("object_id", "baseline_median_um")
    rows = own.join(unsent(chance), "object_id").withColumn("group", F.when(F.substring("object_id", 4, 9).cast("int") % 2 == 0, "even").otherwise("odd"))
    return rounded(rows.groupBy("group", "entity").agg(F.count(F.lit(1)).alias("n_objects"), F.median("median_um").alias("median_um"), F.median("baseline_median_um").alias("chance_um")), 4)


I3 = "object_id, entity, label"
_full = ", ".join(f"({z}, {y}, {x}, {morphology.CROFTON_3D[abs(z) + abs(y) + abs(x)] * 2 * VX / math.sqrt((z * SZ) ** 2 + (y * SY) ** 2 + (x * SX) ** 2)!r}::DOUBLE)" for z, y, x in neighbour_offsets(3))
_flat = ", ".join(f"({y}, {x}, {morphology.CROFTON_2D[abs(y) + abs(x)] * math.pi / 2 * SY * SX / math.sqrt((y * SY) ** 2 + (x * SX) ** 2)!r}::DOUBLE)" for y, x in neighbour_offsets(2))
_SURF = f"SELECT v.object_id, v.entity, v.label, sum(w) AS s FROM vox v, (VALUES {_full}) d(dz, dy, dx, w) WHERE NOT EXISTS (SELECT 1 FROM vox q WHERE q.object_id = v.object_id AND q.entity = v.entity AND q.label = v.label AND q.z = v.z + dz AND q.y = v.y + dy AND q.x = v.x + dx) GROUP BY ALL"
_MOM3 = f"SELECT {I3}, covar_pop(z, z) * {SZ * SZ} AS zz, covar_pop(y, y) * {SY * SY} AS yy, covar_pop(x, x) * {SX * SX} AS xx, covar_pop(z, y) * {SZ * SY} AS zy, covar_pop(z, x) * {SZ * SX} AS zx, covar_pop(y, x) * {SY * SX} AS yx FROM vox GROUP BY ALL"
_MIN = f"d AS (SELECT v.object_id, v.entity, v.label, f.target, min(distance_um) AS distance_um, avg(distance_um) AS distance_mean_um FROM vox v JOIN field f USING (object_id, z, y, x) WHERE v.entity = 'mito' AND f.target <> 'mito' GROUP BY ALL)"
_COMP = """m AS (SELECT object_id, z, y, x, z * 10000 + y * 100 + x AS c FROM vox WHERE entity = 'mito'),
e AS (SELECT a.object_id, a.c AS a, b.c AS b FROM m a JOIN m b ON a.object_id = b.object_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT object_id, a, b FROM e UNION SELECT r.object_id, r.a, e.b FROM r JOIN e ON r.object_id = e.object_id AND r.b = e.a),
t AS (SELECT object_id, a, min(b) AS root FROM r GROUP BY ALL),
k AS (SELECT m.object_id, m.z, m.y, m.x, dense_rank() OVER (PARTITION BY m.object_id ORDER BY root) AS component FROM m JOIN t ON t.object_id = m.object_id AND t.a = m.c)"""
_BASE = f"""bf AS (SELECT f.object_id, target, round(distance_um, 9) AS v FROM field f JOIN inside i USING (object_id, z, y, x)
  WHERE distance_um > 0 AND NOT EXISTS (SELECT 1 FROM vox n WHERE n.entity = 'nucleus' AND n.object_id = f.object_id AND n.z = f.z AND n.y = f.y AND n.x = f.x)),
be AS (SELECT object_id, target, min(v) AS lo, CASE WHEN max(v) <= min(v) THEN 1 ELSE max(v) - min(v) END AS wide, count(*) AS n, avg(v) AS mean FROM bf GROUP BY ALL),
bb AS (SELECT object_id, target, lo, wide, be.n AS total, mean, least({distance.FINE - 1}, floor((v - lo) / wide * {distance.FINE}))::INT AS bin, count(*) AS n FROM bf JOIN be USING (object_id, target) GROUP BY ALL),
bc AS (SELECT *, sum(n) OVER (PARTITION BY object_id, target ORDER BY bin) AS cum FROM bb),
b1 AS (SELECT * FROM bc WHERE cum * 2 >= total QUALIFY row_number() OVER (PARTITION BY object_id, target ORDER BY bin) = 1),
base AS (SELECT object_id, target, total::BIGINT AS baseline_voxels, mean AS baseline_mean_um, lo + (bin + (total / 2 - (cum - n)) / n) * wide / {distance.FINE} AS baseline_median_um FROM b1)"""

SQL = {
    "instance_size": f"{V} SELECT {I3}, round(count(*) * {VX!r}::DOUBLE, 6) AS volume_um3 FROM vox GROUP BY ALL",
    "instance_centroid": f"{V} SELECT {I3}, round(avg(z) * {SZ}, 6) AS z_um, round(avg(y) * {SY}, 6) AS y_um, round(avg(x) * {SX}, 6) AS x_um FROM vox GROUP BY ALL",
    "entity_total": f"{V} SELECT object_id, entity, round(count(*) * {VX!r}::DOUBLE, 6) AS total_volume_um3, CASE WHEN entity = 'mito' THEN count(DISTINCT label)::DOUBLE END AS instance_count FROM vox GROUP BY object_id, entity",
    "object_extent": f"{V} SELECT object_id, round(count(*) * {VX!r}::DOUBLE, 6) AS object_volume_um3 FROM vox WHERE entity = 'cell' GROUP BY ALL",
    "segmented_centre": f"{V} SELECT object_id, round(avg(z) * {SZ}, 6) AS object_center_z_um, round(avg(y) * {SY}, 6) AS object_center_y_um, round(avg(x) * {SX}, 6) AS object_center_x_um FROM (SELECT DISTINCT object_id, z, y, x FROM vox) GROUP BY ALL",
    "instance_aspect": f"{V}, m AS (SELECT {I3}, covar_pop(y, y) * {SY * SY} AS yy, covar_pop(x, x) * {SX * SX} AS xx, covar_pop(y, x) * {SY * SX} AS yx FROM vox WHERE z = 4 GROUP BY ALL), e AS (SELECT *, (yy + xx) / 2 AS h, sqrt(power((yy - xx) / 2, 2) + yx * yx) AS r FROM m) SELECT {I3}, round(CASE WHEN h - r > 1e-12 THEN sqrt((h + r) / (h - r)) ELSE 0 END, 5) AS aspect_ratio_major_minor FROM e",
    "instance_aspect_3d": f"{V}, m AS ({_MOM3}), e AS (SELECT *, (zz + yy + xx) / 3 AS q FROM m), p AS (SELECT *, sqrt((power(zz - q, 2) + power(yy - q, 2) + power(xx - q, 2) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM e), d AS (SELECT *, (zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx) AS det FROM p), f AS (SELECT *, acos(greatest(-1, least(1, coalesce(det / nullif(2 * p * p * p, 0), 1)))) / 3 AS phi FROM d), g2 AS (SELECT *, q + 2 * p * cos(phi) AS big, q + 2 * p * cos(phi + 2 * pi() / 3) AS small FROM f) SELECT {I3}, round(CASE WHEN small > 1e-12 THEN sqrt(big / small) ELSE 0 END, 5) AS aspect_ratio_major_minor FROM g2",
    "instance_boundary": f"{V}, s AS ({_SURF}) SELECT {I3}, round(s, 6) AS surface_area_um2 FROM s",
    "instance_perimeter": f"{V}, p AS (SELECT * FROM vox WHERE z = 4) SELECT {I3}, round(sum(w), 6) AS perimeter_um FROM p v, (VALUES {_flat}) d(dy, dx, w) WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.object_id = v.object_id AND q.entity = v.entity AND q.label = v.label AND q.y = v.y + dy AND q.x = v.x + dx) GROUP BY ALL",
    "instance_roundness": f"{V}, s AS ({_SURF}), n AS (SELECT {I3}, count(*) * {VX!r}::DOUBLE AS v FROM vox GROUP BY ALL) SELECT {I3}, round(cbrt(36 * pi() * v * v) / s, 6) AS sphericity FROM s JOIN n USING ({I3})",
    "bounding_box": f"{V} SELECT {I3}, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x, count(*) AS n, round(count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS fill_ratio FROM vox GROUP BY ALL",
    "clip_to_mask": f"{V} SELECT v.* FROM vox v SEMI JOIN (SELECT object_id, z, y, x FROM vox WHERE entity = 'cell') m ON m.object_id = v.object_id AND m.z = v.z AND m.y = v.y AND m.x = v.x",
    "sql_measures": f"{V}, m AS (SELECT {I3}, count(*) AS n, avg(z) * {SZ} AS z_um, avg(y) * {SY} AS y_um, avg(x) * {SX} AS x_um, min(z)::DOUBLE AS min_z, max(z)::DOUBLE AS max_z, min(y)::DOUBLE AS min_y, max(y)::DOUBLE AS max_y, min(x)::DOUBLE AS min_x, max(x)::DOUBLE AS max_x FROM vox GROUP BY ALL), w AS (SELECT {I3}, n * {VX!r}::DOUBLE AS volume_um3, z_um, y_um, x_um, min_z, max_z, min_y, max_y, min_x, max_x, n / ((max_z - min_z + 1) * (max_y - min_y + 1) * (max_x - min_x + 1)) AS fill_ratio FROM m) SELECT object_id, entity, label::BIGINT AS label, metric, round(value, 6) AS value FROM (UNPIVOT w ON volume_um3, z_um, y_um, x_um, min_z, max_z, min_y, max_y, min_x, max_x, fill_ratio INTO NAME metric VALUE value)",
    "seeded_flood": f"{V}, s AS (SELECT object_id, z, y, x FROM vox WHERE entity = 'cell'), o AS (SELECT * FROM (VALUES (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) o(dz, dy, dx)), f AS (SELECT v.object_id, v.z, v.y, v.x, label AS seed, 0 AS steps FROM vox v SEMI JOIN s ON s.object_id = v.object_id AND s.z = v.z AND s.y = v.y AND s.x = v.x WHERE entity = 'mito' UNION SELECT s.object_id, s.z, s.y, s.x, seed, steps + 1 FROM f, o, s WHERE s.object_id = f.object_id AND s.z = f.z + dz AND s.y = f.y + dy AND s.x = f.x + dx AND steps < 24) SELECT object_id, z, y, x, min(steps)::BIGINT AS steps, arg_min(seed, (steps, seed))::BIGINT AS seed FROM f GROUP BY ALL",
    "crop_to_bbox": f"{V}, b AS (SELECT object_id, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM vox WHERE entity = 'nucleus' GROUP BY 1) SELECT object_id, entity, z - z0 AS z, y - y0 AS y, x - x0 AS x, label FROM vox JOIN b USING (object_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1",
    "label_map_split": f"{V} SELECT object_id, CASE label WHEN 1 THEN 'left' ELSE 'right' END AS entity, z, y, x, 1 AS label FROM vox WHERE entity = 'mito' AND label IN (1, 3)",
    "auto_kind": f"{V} SELECT object_id, entity, CASE WHEN entity <> 'cell' AND count(DISTINCT label) > 1 THEN 'label' ELSE 'mask' END AS entity_kind FROM vox GROUP BY object_id, entity",
    "channel_order": f"{V}, k AS (SELECT object_id, entity, CASE WHEN entity <> 'cell' AND count(DISTINCT label) > 1 THEN 'label' ELSE 'mask' END AS entity_kind FROM vox GROUP BY object_id, entity) SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY entity <> 'cell', entity_kind || ':' || entity) - 1 AS channel FROM k",
    "edge_touch": f"{V} SELECT object_id, entity, min(z) = 0 OR max(z) = {source.SHAPE[0] - 1} AS touches_z, min(y) = 0 OR max(y) = {source.SHAPE[1] - 1} AS touches_y, min(x) = 0 OR max(x) = {source.SHAPE[2] - 1} AS touches_x FROM vox GROUP BY ALL",
    "distance_transform": f"{V}, {_dist_sql()} SELECT object_id, target, z, y, x, round(distance_um, 6) AS distance_um FROM field",
    "distance_min": f"{V}, {_dist_sql()}, {_MIN} SELECT object_id, entity, label, target, round(distance_um, 6) AS distance_um, round(distance_mean_um, 6) AS distance_mean_um FROM d",
    "distance_to_boundary": f"{V}, {_dist_sql()}, {_MIN} SELECT object_id, label, round(distance_um, 6) AS distance_um FROM d WHERE target = 'cell'",
    "distance_histogram": f"{V}, {_dist_sql()}, m AS (SELECT v.object_id, v.entity, v.label, f.target, round(distance_um, 9) AS v FROM vox v JOIN field f USING (object_id, z, y, x) WHERE v.entity = 'mito' AND f.target <> 'mito'), e AS (SELECT object_id, entity, target, min(v) AS lo, max(v) AS hi FROM m GROUP BY ALL), b AS (SELECT m.object_id, m.entity, m.label, m.target, lo, hi, least(19, greatest(0, floor((v - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END * 20)))::INT AS bin, count(*) AS n FROM m JOIN e ON m.object_id = e.object_id AND m.target = e.target GROUP BY ALL), k AS (SELECT DISTINCT object_id, entity, label, target, lo, hi FROM b) SELECT k.object_id, k.entity, k.label, k.target, round(lo, 6) AS hist_min, round(hi, 6) AS hist_max, '[' || (SELECT string_agg(coalesce(b.n, 0), ',' ORDER BY r.i) FROM range(20) r(i) LEFT JOIN b ON b.bin = r.i AND b.object_id = k.object_id AND b.label = k.label AND b.target = k.target) || ']' AS hist_counts FROM k",
    "distance_wide": f"{V}, {_dist_sql()}, {_MIN} SELECT {I3}, round(max(distance_um) FILTER (target = 'cell'), 6) AS distance_to_cell_um, round(max(distance_um) FILTER (target = 'nucleus'), 6) AS distance_to_nucleus_um FROM d GROUP BY ALL",
    "baseline_stats": f"{V}, {_dist_sql()}, {_BASE} SELECT object_id, target, baseline_voxels, round(baseline_mean_um, 6) AS baseline_mean_um, round(baseline_median_um, 6) AS baseline_median_um FROM base",
    "baseline_histogram": f"{V}, {_dist_sql()}, {_BASE}, hc AS (SELECT object_id, target, bin // {distance.FINE // distance.COARSE} AS bin, sum(n) AS n, any_value(lo) AS lo, any_value(wide) AS wide FROM bb WHERE target = 'cell' GROUP BY ALL), ho AS (SELECT object_id, target, any_value(lo) AS lo, any_value(wide) AS wide FROM hc GROUP BY ALL) SELECT ho.object_id, ho.target, round(lo, 6) AS baseline_hist_min_um, round(lo + wide, 6) AS baseline_hist_max_um, '[' || (SELECT string_agg(coalesce(hc.n, 0)::BIGINT, ',' ORDER BY r.i) FROM range({distance.COARSE}) r(i) LEFT JOIN hc ON hc.bin = r.i AND hc.object_id = ho.object_id) || ']' AS baseline_hist_counts FROM ho",
    "tip_distance": f"{V}, {_dist_sql()}, bx AS (SELECT {I3}, min(z) a, min(y) b, min(x) c, max(z) d, max(y) e, max(x) f FROM vox WHERE entity = 'mito' GROUP BY ALL), tp AS (SELECT {I3}, a AS z, b AS y, c AS x FROM bx UNION SELECT {I3}, d, e, f FROM bx) SELECT object_id, tp.entity, tp.label, target, round(min(distance_um), 6) AS distance_end_min_um, round(max(distance_um), 6) AS distance_end_max_um FROM tp JOIN field USING (object_id, z, y, x) WHERE target <> 'mito' GROUP BY ALL",
    "geometry_rows": f"{V}, s AS ({_SURF}), n AS (SELECT {I3}, count(*) AS k, count(*) * {VX!r}::DOUBLE AS v, count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS fill FROM vox GROUP BY ALL), ga AS (SELECT a.object_id, a.label AS label_a, b.label AS label_b, min(sqrt(power((a.z - b.z) * {SZ}::DOUBLE, 2) + power((a.y - b.y) * {SY}::DOUBLE, 2) + power((a.x - b.x) * {SX}::DOUBLE, 2))) AS gap_um FROM vox a JOIN vox b ON a.object_id = b.object_id AND a.entity = 'mito' AND b.entity = 'mito' AND a.label < b.label GROUP BY ALL) SELECT object_id, CASE WHEN entity = 'mito' THEN 'instance' ELSE 'file' END AS row_type, entity AS entity_name, CASE WHEN entity = 'mito' THEN label END AS label, k AS voxels, round(v, 5) AS volume_um3, round(cbrt(36 * pi() * v * v) / s, 5) AS sphericity, round(fill, 5) AS fill_ratio, k >= 8 AS has_surface, NULL AS entity_a, NULL AS label_a, NULL AS label_b, NULL::DOUBLE AS gap_um FROM s JOIN n USING ({I3}) UNION ALL SELECT object_id, 'contact', NULL, NULL, NULL, NULL, NULL, NULL, false, 'mito', label_a, label_b, round(gap_um, 5) FROM ga WHERE gap_um <= 0.16",
    "polar_depth": f"{V}, {_dist_sql()}, c AS (SELECT object_id, entity, round_even(avg(z), 0)::INT AS z, round_even(avg(y), 0)::INT AS y, round_even(avg(x), 0)::INT AS x FROM vox GROUP BY ALL) SELECT c.object_id, c.entity, round(coalesce(distance_um, 0), 6) AS polar_depth_um FROM c LEFT JOIN field f ON f.target = 'cell' AND f.object_id = c.object_id AND f.z = c.z AND f.y = c.y AND f.x = c.x WHERE c.entity <> 'cell'",
    "polar_spread": f"{V}, c AS (SELECT object_id, avg(z) cz, avg(y) cy, avg(x) cx FROM vox WHERE entity = 'cell' GROUP BY 1), o AS (SELECT v.object_id, label, (z - cz) * {SZ} AS z, (y - cy) * {SY} AS y, (x - cx) * {SX} AS x FROM vox v JOIN c USING (object_id) WHERE entity = 'mito'), n AS (SELECT object_id, label, z / sqrt(z*z+y*y+x*x) AS z, y / sqrt(z*z+y*y+x*x) AS y, x / sqrt(z*z+y*y+x*x) AS x FROM o WHERE z*z+y*y+x*x > 0), m AS (SELECT object_id, label, avg(z) mz, avg(y) my, avg(x) mx FROM n GROUP BY ALL), a AS (SELECT object_id, label, degrees(acos(greatest(-1, least(1, (z*mz + y*my + x*mx) / sqrt(mz*mz+my*my+mx*mx))))) AS a FROM n JOIN m USING (object_id, label)) SELECT object_id, label, round(CASE WHEN count(a) >= 3 THEN stddev_pop(a) END, 5) AS polar_spread_deg FROM a GROUP BY ALL",
    "voxel_components": f"{V}, {_COMP} SELECT object_id, 'mito' AS entity, z, y, x, component::INT AS component FROM k",
    "promote_masks": f"{V}, {_COMP} SELECT object_id, 'mito' AS entity, count(DISTINCT component) AS n_components, CASE WHEN count(DISTINCT component) > 1 THEN 'label' ELSE 'mask' END AS entity_kind FROM k GROUP BY ALL",
    "dilation": f"{V}, o AS (SELECT unnest(range(-1, 2)) AS d) SELECT DISTINCT object_id, entity, (z + a.d)::INT AS z, (y + b.d)::INT AS y, (x + c.d)::INT AS x FROM vox, o a, o b, o c WHERE entity = 'mito'",
    "flagship": f"""{V}, {_dist_sql()}, {_MIN}, {_BASE}, o AS (SELECT object_id, entity, median(distance_um) AS m FROM d WHERE target = 'cell' GROUP BY ALL), j AS (SELECT o.*, b.baseline_median_um AS c, CASE WHEN substr(o.object_id, 4)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS grp FROM o JOIN base b ON b.object_id = o.object_id AND b.target = 'cell') SELECT grp AS "group", entity, count(*) AS n_objects, round(median(m), 4) AS median_um, round(median(c), 4) AS chance_um FROM j GROUP BY ALL""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "surface_mesh", "cell_basins", "centre_lines"]}
