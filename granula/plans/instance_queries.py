"""Queries over the embeddings table read as instances, with SQL.

label = entity, vec_id = instance, vec_id % 4 = object, the first three dimensions = position,
the size of the fourth = weight.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.functions import scalar
from granula.functions.storage import stored, unsent
from granula.operators import branches, contacts, polarity, scene, stats
from granula.plans.voxel_queries import rounded

R = 0.12


def inst(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.round(F.element_at("embedding", k).cast("double"), 6)
    return v.select(
        (F.col("vec_id") % 4).alias("object_id"), F.col("label").alias("entity"), F.col("vec_id").alias("label"),
        at(1).alias("z"), at(2).alias("y"), at(3).alias("x"), F.abs(at(4)).alias("size"), F.abs(at(5)).alias("d5"), at(6).alias("d6"),
    )


def unit(spark, sf_dir):
    rows = inst(spark, sf_dir)
    d = scalar.direction(F.col("z"), F.col("y"), F.col("x"))
    rows = rows.withColumns({"dist": d["polar_dist_um"], "nz": d["polar_nz"], "ny": d["polar_ny"], "nx": d["polar_nx"], "az_deg": d["polar_az_deg"]})
    rows = polarity.size_weights(rows.where("nz is not null"), "size", ["object_id", "entity"])
    return rows.withColumns({"az": F.lit(0.0), "ay": F.lit(0.6), "ax": F.lit(0.8)})


def polarity_3d(spark, sf_dir):
    rows = inst(spark, sf_dir)
    return rounded(rows.select("object_id", "label", *[c.alias(n) for n, c in scalar.direction(F.col("z"), F.col("y"), F.col("x")).items()]))


def polarity_2d(spark, sf_dir):
    rows = inst(spark, sf_dir)
    return rounded(rows.select("object_id", "label", *[c.alias(n) for n, c in scalar.direction(None, F.col("y"), F.col("x")).items()]))


def nearest_same_type(spark, sf_dir):
    return rounded(contacts.nearest_same_type(inst(spark, sf_dir), R))


def contact_pairs(spark, sf_dir):
    return rounded(contacts.contact_pairs(inst(spark, sf_dir), R))


def contact_count(spark, sf_dir):
    return contacts.contact_pairs(inst(spark, sf_dir), R).groupBy("object_id").agg(F.count(F.lit(1)).alias("contact_count"))


def widest_gap(spark, sf_dir):
    return rounded(contacts.contact_pairs(inst(spark, sf_dir), R).agg(F.max("gap_um").alias("gap_um")))


def scene_edges(spark, sf_dir):
    found = contacts.contact_pairs(inst(spark, sf_dir), R).where(f"gap_um <= {R / 2}")
    return found.select(F.col("entity").alias("entity_a"), "label_a", F.col("entity").alias("entity_b"), "label_b")


def contact_structures(spark, sf_dir):
    return contacts.contact_pairs(inst(spark, sf_dir), R).select("entity").distinct()


def contact_clusters(spark, sf_dir):
    i = inst(spark, sf_dir)
    return contacts.cluster_sizes(contacts.near_clusters(i, R))


def _reach(spark, sf_dir):
    i = inst(spark, sf_dir)
    d = i.select("object_id", "entity", "label", F.when(F.col("label") % 7 != 0, F.round("d5", 3)).alias("reach"))
    return d, contacts.cluster_reach(contacts.near_clusters(i, R), d)


def cluster_reach(spark, sf_dir):
    return rounded(_reach(spark, sf_dir)[1])


def cluster_chance(spark, sf_dir):
    d, reached = _reach(spark, sf_dir)
    return rounded(contacts.cluster_chance(reached, d))


def reference_offset(spark, sf_dir):
    return rounded(polarity.reference_offset(unit(spark, sf_dir), ["object_id", "entity"]))


def polarity_rv(spark, sf_dir):
    return rounded(polarity.polarity(unit(spark, sf_dir), ["object_id", "entity"]))


def cone_angle(spark, sf_dir):
    return rounded(polarity.cone_angles(unit(spark, sf_dir)).select("object_id", "label", "cone_deg"), 4)


def circular_mean(spark, sf_dir):
    return rounded(polarity.circular_mean(unit(spark, sf_dir), ["object_id", "entity"], "az_deg"), 5)


def weighted_quantile(spark, sf_dir):
    rows = unit(spark, sf_dir).withColumn("w", (F.floor(F.col("size") * 1000) + 1).cast("double"))
    return rounded(polarity.weighted_quantile(rows, ["entity"], "d5", 0.25))


def centre_recovery(spark, sf_dir):
    return rounded(polarity.recovered_centres(unit(spark, sf_dir), ["object_id"], dict.fromkeys("zyx", "d6")))


def surface_choice(spark, sf_dir):
    rows = inst(spark, sf_dir)
    return rows.select("label", scalar.surface_choice(F.col("size") * 30, F.col("d5") * 6, F.floor(F.col("d5") * 20), F.col("label") % 2 == 0).alias("surface"))


def smoothing_sigma(spark, sf_dir):
    return rounded(inst(spark, sf_dir).select("label", scalar.smoothing_sigma(F.when(F.col("label") % 5 != 0, F.col("d5") * 5), F.col("size") * 4).alias("sigma")))


def ellipsoid_guard(spark, sf_dir):
    return inst(spark, sf_dir).select("label", scalar.ellipsoid_ok(F.col("size") - 0.01, F.col("d5"), F.col("d5") * 2).alias("drawable"))


def shown(spark, sf_dir):
    """Instances as rows of a geometry file: every seventh has no surface."""
    rows = inst(spark, sf_dir).withColumn("row_type", F.when(F.col("label") % 3 == 0, "file").otherwise("instance"))
    return rows.select(
        "object_id", F.col("entity").alias("entity_name"), "row_type", "label", F.col("d6").alias("metric"), F.col("size").alias("volume_um3"), F.lit(None).cast("double").alias("area_um2"),
        F.floor(F.col("size") * 100).alias("surface_elements"), F.when(F.col("label") % 7 != 0, F.lit("m").cast("binary")).alias("surface"), F.lit(None).cast("binary").alias("outline"),
    )


def _gallery(spark, sf_dir, pick):
    return scene.gallery(shown(spark, sf_dir).where("entity_name = 3"), "metric", pick, 12).select(F.col("entity_name").alias("entity"), "label", "metric")


def gallery_top(spark, sf_dir):
    return _gallery(spark, sf_dir, "highest")


def gallery_bottom(spark, sf_dir):
    return _gallery(spark, sf_dir, "lowest")


def gallery_random(spark, sf_dir):
    """Twelve instances by a seeded hash; the same ones on every run."""
    return _gallery(spark, sf_dir, "random")


def gallery_count(spark, sf_dir):
    return scene.gallery_rows(shown(spark, sf_dir), "metric").groupBy(F.col("entity_name").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


def scene_geometry(spark, sf_dir):
    found = scene.geometry(shown(spark, sf_dir), [1, 3, 5], ["metric"])
    return found.select("entity_name", "row_type", "label", "metric", "size", F.col("surface").isNotNull().alias("has_surface"))


def scene_summary(spark, sf_dir):
    return scene.summary(shown(spark, sf_dir)).select(F.col("entity_name").alias("entity"), "row_type", "n", "elements")


def metric_span(spark, sf_dir):
    return scene.metric_span(shown(spark, sf_dir), "metric").select(F.col("entity_name").alias("entity"), "low", "high")


def explode_offset(spark, sf_dir):
    rows = unit(spark, sf_dir)
    return rounded(rows.select("object_id", "label", *[(F.col(f"n{a}") * F.col("dist") * 0.5).alias(f"shift_{a}") for a in "xyz"]), 4)


def skeleton_degree(spark, sf_dir):
    """Degrees of the contact graph read as a skeleton: tips have one edge."""
    e = contacts.contact_pairs(inst(spark, sf_dir), R)
    ends = e.select("object_id", F.col("label_a").alias("vertex")).unionAll(e.select("object_id", "label_b"))
    return ends.groupBy("object_id", "vertex").agg(F.count(F.lit(1)).alias("degree"))


def skeleton_tips(spark, sf_dir):
    return skeleton_degree(spark, sf_dir).where("degree = 1").select("object_id", "vertex")


def cable_length(spark, sf_dir):
    e = contacts.contact_pairs(inst(spark, sf_dir), R)
    return rounded(inst(spark, sf_dir).select("object_id").distinct().join(e, "object_id", "left").groupBy("object_id").agg(F.coalesce(F.sum("gap_um"), F.lit(0.0)).alias("length_um")), 5)


def _degrees(i):
    """(object_id, entity, v, degree) of the contact graphs' vertices with an edge; pairs are counted where they are found."""
    ends = contacts.contact_pairs(i, R).select("object_id", "entity", F.explode(F.array("label_a", "label_b")).alias("v"))
    return stored(ends.groupBy("object_id", "entity", "v").agg(F.count(F.lit(1)).alias("degree")), "contact-degrees")


def _dense_graph(spark, sf_dir):
    """(edges with their gaps and the degrees of their ends, vertices, degrees) of these graphs; the edges are found by joins and not written."""
    i, keys = inst(spark, sf_dir), ["object_id", "entity"]
    degree = _degrees(i)
    placed = i.join(unsent(degree.withColumnRenamed("v", "label")), [*keys, "label"])
    edges = contacts.contact_pairs(placed, R, ("degree",)).withColumnsRenamed({"label_a": "a", "label_b": "b"})
    return edges, i.select(*keys, F.col("label").alias("v"), "z", "y", "x"), degree


def skeleton_metrics(spark, sf_dir):
    """Branches, length and tortuosity of each entity's contact graph read as a skeleton."""
    edges, vertices, degree = _dense_graph(spark, sf_dir)
    return rounded(branches.dense_metrics(edges, vertices, degree, ["object_id", "entity"]))


def skeleton_branches(spark, sf_dir):
    """Every branch of these graphs: its ends, edges, length, and smoothed arc and chord."""
    edges, vertices, degree = _dense_graph(spark, sf_dir)
    return rounded(branches.dense_shapes(edges, vertices, degree, ["object_id", "entity"]))


def pruned_spurs(spark, sf_dir):
    """The edges of these graphs that stay when ends shorter than their junction's radius (the size of its instance) are cut; they are found by joins and not written."""
    i, keys = inst(spark, sf_dir), ["object_id", "entity"]

    def edges_at(marks):
        own = i.join(unsent(marks.withColumnRenamed("v", "label")), [*keys, "label"], "left_semi")
        met = contacts.band_join(own, i, R).where("label_a <> label_b")
        return met.select(*keys, F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b"))

    vertices = i.select(*keys, F.col("label").alias("v"), "z", "y", "x", F.col("size").alias("radius"))
    bare = branches.dense_spurs(edges_at, vertices, _degrees(i), keys, factor=1.0)
    kept = i if bare is None else i.join(unsent(bare.withColumnRenamed("v", "label")), [*keys, "label"], "left_anti")
    return contacts.contact_pairs(kept, R).select(*keys, F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def log_binomial(spark, sf_dir):
    sizes = inst(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.select("entity", "n", stats.log_binomial(F.col("n"), F.lit(5)).alias("ln_binomial")))


B = "WITH RECURSIVE i AS (SELECT vec_id % 4 AS object_id, label AS entity, vec_id AS label, round(embedding[1]::DOUBLE, 6) AS z, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS x, abs(round(embedding[4]::DOUBLE, 6)) AS size, abs(round(embedding[5]::DOUBLE, 6)) AS d5, round(embedding[6]::DOUBLE, 6) AS d6 FROM embeddings)"
P = "c AS (SELECT a.object_id, a.entity, a.label AS label_a, b.label AS label_b, sqrt(power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2)) AS gap_um FROM i a JOIN i b ON a.object_id = b.object_id AND a.entity = b.entity AND a.label < b.label)"
C = f"{B}, {P}, p AS (SELECT * FROM c WHERE gap_um <= {R})"
K = f"{C}, e AS (SELECT object_id, entity, label_a AS a, label_b AS b FROM p UNION ALL SELECT object_id, entity, label_b, label_a FROM p), r AS (SELECT object_id, entity, label AS a, label AS b FROM i UNION SELECT r.object_id, r.entity, r.a, e.b FROM r JOIN e ON e.object_id = r.object_id AND e.entity = r.entity AND e.a = r.b), k AS (SELECT object_id, entity, a AS label, min(b) AS cluster FROM r GROUP BY ALL)"
RE = f"{K}, d AS (SELECT object_id, entity, label, CASE WHEN label % 7 <> 0 THEN round(d5, 3) END AS reach FROM i), q AS (SELECT object_id, entity, cluster, count(*) AS n, min(reach) AS reach FROM k JOIN d USING (object_id, entity, label) GROUP BY ALL HAVING count(*) >= 2)"
U = f"{B}, u0 AS (SELECT *, sqrt(z*z + y*y + x*x) AS dist FROM i), u AS (SELECT *, z / dist AS nz, y / dist AS ny, x / dist AS nx, degrees(atan2(y / dist, x / dist)) AS az_deg, CASE WHEN count(CASE WHEN size > 0 THEN 1 END) OVER s = count(*) OVER s THEN size ELSE 1 END AS w FROM u0 WHERE dist > 0 WINDOW s AS (PARTITION BY object_id, entity))"
SH = f"{B}, s AS (SELECT object_id, entity, label, d6 AS metric, size, CASE WHEN label % 3 = 0 THEN 'file' ELSE 'instance' END AS row_type, label % 7 <> 0 AS has_surface FROM i)"
#: Walks from every vertex whose degree is not 2 over those whose degree is, in the direction that ends no later than it starts.
WALK = (
    f"{C}, e AS (SELECT object_id, entity, label_a AS a, label_b AS b FROM p UNION ALL SELECT object_id, entity, label_b, label_a FROM p), g AS (SELECT object_id, entity, a AS v, count(*) AS degree FROM e GROUP BY ALL), "
    "w AS (SELECT e.object_id, e.entity, e.a AS s, e.b AS s1, e.a AS was, e.b AS v, 1 AS pos FROM e JOIN g ON g.object_id = e.object_id AND g.entity = e.entity AND g.v = e.a WHERE degree <> 2 "
    "UNION ALL SELECT w.object_id, w.entity, s, s1, w.v, e.b, pos + 1 FROM w JOIN g ON g.object_id = w.object_id AND g.entity = w.entity AND g.v = w.v AND degree = 2 JOIN e ON e.object_id = w.object_id AND e.entity = w.entity AND e.a = w.v AND e.b <> w.was), "
    "t AS (SELECT w.object_id, w.entity, s, s1, was AS t1, w.v AS t, pos AS n FROM w JOIN g ON g.object_id = w.object_id AND g.entity = w.entity AND g.v = w.v WHERE degree <> 2 AND (s < w.v OR s = w.v AND s1 <= was)), "
    "l AS (SELECT t.*, pos, v FROM t JOIN (SELECT object_id, entity, s, s1, pos, v FROM w UNION ALL SELECT object_id, entity, s, s1, 0, s FROM w WHERE pos = 1) USING (object_id, entity, s, s1)), "
    "l0 AS (SELECT l.*, z, y, x FROM l JOIN i ON i.label = l.v)"
)
_SOFT = "SELECT object_id, entity, s, s1, t1, t, n, pos, " + ", ".join(f"CASE WHEN pos = 0 OR pos = n THEN {c} ELSE avg({c}) OVER m END AS {c}" for c in "zyx") + " FROM {} WINDOW m AS (PARTITION BY object_id, entity, s, s1, t1, t ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_ARC = "(SELECT object_id, entity, s, s1, t1, t, sum(d) AS {1} FROM (SELECT *, sqrt(power(z - lag(z) OVER m, 2) + power(y - lag(y) OVER m, 2) + power(x - lag(x) OVER m, 2)) AS d FROM {0} WINDOW m AS (PARTITION BY object_id, entity, s, s1, t1, t ORDER BY pos)) GROUP BY ALL)"
SHAPES = (
    f"{WALK}, m1 AS ({_SOFT.format('l0')}), m2 AS ({_SOFT.format('m1')}), "
    f"b AS (SELECT f.object_id, f.entity, f.s, f.s1, f.t1, f.t, f.n, length_um, arc_um, sqrt(power(f.z - k.z, 2) + power(f.y - k.y, 2) + power(f.x - k.x, 2)) AS chord_um FROM l0 f JOIN l0 k USING (object_id, entity, s, s1, t1, t) "
    f"JOIN {_ARC.format('l0', 'length_um')} USING (object_id, entity, s, s1, t1, t) JOIN {_ARC.format('m2', 'arc_um')} USING (object_id, entity, s, s1, t1, t) WHERE f.pos = 0 AND k.pos = k.n)"
)
G = "(SELECT entity, label, metric FROM s WHERE entity = 3 AND row_type = 'instance' AND has_surface ORDER BY {} LIMIT 12)"

SQL = {
    "polarity_3d": f"{B}, u AS (SELECT *, sqrt(z*z + y*y + x*x) AS d FROM i) SELECT object_id, label, round(d, 6) AS polar_dist_um, round(y / d, 6) AS polar_ny, round(x / d, 6) AS polar_nx, round(z / d, 6) AS polar_nz, round(degrees(atan2(y / d, x / d)), 6) AS polar_az_deg, round(degrees(asin(greatest(-1, least(1, z / d)))), 6) AS polar_el_deg FROM u",
    "polarity_2d": f"{B}, u AS (SELECT *, sqrt(y*y + x*x) AS d FROM i) SELECT object_id, label, round(d, 6) AS polar_dist_um, round(y / d, 6) AS polar_ny, round(x / d, 6) AS polar_nx, round(degrees(atan2(y / d, x / d)), 6) AS polar_angle_deg FROM u",
    "nearest_same_type": f"{B} SELECT a.object_id, a.entity, a.label, round(min(sqrt(power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2))), 6) AS instance_distance_to_closest_same_type_um FROM i a LEFT JOIN i b ON a.object_id = b.object_id AND a.entity = b.entity AND a.label <> b.label GROUP BY ALL",
    "contact_pairs": f"{C} SELECT object_id, entity, label_a, label_b, round(gap_um, 6) AS gap_um FROM p",
    "contact_count": f"{C} SELECT object_id, count(*) AS contact_count FROM p GROUP BY ALL",
    "widest_gap": f"{C} SELECT round(max(gap_um), 6) AS gap_um FROM p",
    "scene_edges": f"{C} SELECT entity AS entity_a, label_a, entity AS entity_b, label_b FROM p WHERE gap_um <= {R / 2}",
    "contact_structures": f"{C} SELECT DISTINCT entity FROM p",
    "contact_clusters": f"{K} SELECT object_id, entity, cluster, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 2",
    "cluster_reach": f"{RE} SELECT object_id, entity, cluster, n, round(reach, 6) AS reach FROM q",
    "cluster_chance": f"{RE}, t AS (SELECT q.*, (SELECT count(*) FROM d WHERE d.object_id = q.object_id AND d.entity = q.entity AND d.reach > q.reach) AS g, (SELECT count(*) FROM d WHERE d.object_id = q.object_id AND d.entity = q.entity AND d.reach >= q.reach) AS ge, (SELECT count(d.reach) FROM d WHERE d.object_id = q.object_id AND d.entity = q.entity) AS m FROM q WHERE reach IS NOT NULL), f AS (SELECT *, CASE WHEN g < n THEN 0 ELSE exp((SELECT sum(ln((g - s) / (m - s))) FROM range(n) x(s))) END AS a, CASE WHEN ge < n THEN 0 ELSE exp((SELECT sum(ln((ge - s) / (m - s))) FROM range(n) x(s))) END AS b FROM t) SELECT object_id, entity, cluster, n, round(reach, 6) AS reach, round(100 * (a + (b - a) / 2), 6) AS chance_percent FROM f",
    "reference_offset": f"{U}, o AS (SELECT object_id, entity, sum(w * nz * dist) / sum(w) AS oz, sum(w * ny * dist) / sum(w) AS oy, sum(w * nx * dist) / sum(w) AS ox FROM u GROUP BY ALL) SELECT object_id, entity, round(oz, 6) AS oz, round(oy, 6) AS oy, round(ox, 6) AS ox, round(CASE WHEN sqrt(oz*oz + oy*oy + ox*ox) > 1e-12 THEN sqrt(oz*oz + oy*oy + ox*ox) END, 6) AS offset_um FROM o",
    "polarity_rv": f"{U} SELECT object_id, entity, round(sqrt(power(sum(w * nz), 2) + power(sum(w * ny), 2) + power(sum(w * nx), 2)) / sum(w), 6) AS polarity_r, round(sum(w * (ny * 0.6 + nx * 0.8)) / sum(w), 6) AS polarity_v FROM u GROUP BY ALL",
    "cone_angle": f"{U} SELECT object_id, label, round(degrees(acos(greatest(-1, least(1, ny * 0.6::DOUBLE + nx * 0.8::DOUBLE)))), 4) AS cone_deg FROM u",
    "circular_mean": f"{U}, s AS (SELECT object_id, entity, sum(w * sin(radians(az_deg))) AS s, sum(w * cos(radians(az_deg))) AS c FROM u GROUP BY ALL) SELECT object_id, entity, round(CASE WHEN sqrt(s*s + c*c) > 1e-9 THEN degrees(atan2(s, c)) END, 5) AS circular_mean_deg FROM s",
    "weighted_quantile": f"{U}, v AS (SELECT entity, d5, floor(size * 1000) + 1 AS w FROM u), s AS (SELECT entity, d5, sum(w) OVER (PARTITION BY entity ORDER BY d5 RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY entity) AS t FROM v) SELECT entity, round(min(d5) FILTER (c >= 0.25 * t), 6) AS quantile FROM s GROUP BY ALL",
    "centre_recovery": f"{U} SELECT object_id, round(median(d6 - nz * dist), 6) AS centre_z, round(median(d6 - ny * dist), 6) AS centre_y, round(median(d6 - nx * dist), 6) AS centre_x FROM u GROUP BY ALL",
    "surface_choice": f"{B} SELECT label, CASE WHEN label % 2 = 0 AND size * 30 >= 3 AND floor(d5 * 20) >= 1 THEN 'tube' WHEN d5 * 6 >= 0.75 AND size * 30 BETWEEN 1 AND 3 THEN 'ellipsoid' ELSE 'mesh' END AS surface FROM i",
    "smoothing_sigma": f"{B} SELECT label, round(CASE WHEN label % 5 = 0 THEN 1.0 ELSE 0.5 + sqrt(greatest(0, d5 * 5 * least(1, size * 4 / (pi() / 6)))) END, 6) AS sigma FROM i",
    "ellipsoid_guard": f"{B} SELECT label, coalesce(least(size - 0.01, d5, d5 * 2) > 0 AND greatest(size - 0.01, d5, d5 * 2) / cbrt((size - 0.01) * d5 * (d5 * 2)) <= 100, false) AS drawable FROM i",
    "gallery_top": f"{SH} SELECT * FROM {G.format('metric DESC, label')}",
    "gallery_bottom": f"{SH} SELECT * FROM {G.format('metric, label')}",
    "gallery_random": f"{SH} SELECT * FROM {G.format('md5(label::VARCHAR), label')}",
    "gallery_count": f"{SH} SELECT entity, count(*) AS n FROM s WHERE row_type = 'instance' AND has_surface AND isfinite(metric) GROUP BY ALL",
    "scene_geometry": f"{SH} SELECT entity AS entity_name, row_type, label, metric, size, has_surface FROM s WHERE entity IN (1, 3, 5)",
    "scene_summary": f"{SH} SELECT entity, row_type, count(*) AS n, sum(floor(size * 100))::BIGINT AS elements FROM s GROUP BY ALL",
    "metric_span": f"{SH} SELECT entity, min(metric) AS low, max(metric) AS high FROM s GROUP BY ALL",
    "explode_offset": f"{U} SELECT object_id, label, round(nx * dist * 0.5, 4) AS shift_x, round(ny * dist * 0.5, 4) AS shift_y, round(nz * dist * 0.5, 4) AS shift_z FROM u",
    "skeleton_degree": f"{C} SELECT object_id, v AS vertex, count(*) AS degree FROM (SELECT object_id, label_a AS v FROM p UNION ALL SELECT object_id, label_b FROM p) GROUP BY ALL",
    "skeleton_tips": f"{C} SELECT object_id, v AS vertex FROM (SELECT object_id, label_a AS v FROM p UNION ALL SELECT object_id, label_b FROM p) GROUP BY ALL HAVING count(*) = 1",
    "cable_length": f"{C} SELECT o.object_id, round(coalesce(sum(gap_um), 0), 5) AS length_um FROM (SELECT DISTINCT object_id FROM i) o LEFT JOIN p USING (object_id) GROUP BY ALL",
    "skeleton_branches": f"{SHAPES} SELECT object_id, entity, s, s1, t1, t, n, round(length_um, 6) AS length_um, round(arc_um, 6) AS arc_um, round(chord_um, 6) AS chord_um FROM b",
    "skeleton_metrics": f"{SHAPES}, k AS (SELECT object_id, entity, count(*) AS runs, sum(arc_um) FILTER (chord_um > 0) AS arc, sum(arc_um * arc_um / chord_um) FILTER (chord_um > 0) AS bent FROM b GROUP BY ALL), c0 AS (SELECT object_id, entity, sum(gap_um) AS len FROM p GROUP BY ALL) SELECT object_id, entity, (CASE WHEN len IS NULL THEN 0 ELSE coalesce(runs, 1) END)::INT AS instance_branches, round(coalesce(len, 0), 6) AS instance_length_um, round(bent / arc, 6) AS instance_tortuosity FROM (SELECT DISTINCT object_id, entity FROM i) LEFT JOIN k USING (object_id, entity) LEFT JOIN c0 USING (object_id, entity)",
    "log_binomial": f"{B}, n AS (SELECT entity, count(*) AS n FROM i GROUP BY ALL) SELECT entity, n, round((SELECT sum(ln(n - s)) - sum(ln(s + 1)) FROM range(5) x(s)), 6) AS ln_binomial FROM n",
}
QUERIES = {name: globals()[name] for name in [*SQL, "pruned_spurs"]}
