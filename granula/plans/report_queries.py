"""Queries of row algebra, viewer maths and settings, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granula.functions import scalar
from granula.operators import bricks, graph, morphology, polarity, report, rows, stats
from granula.plans import instance_queries as iq
from granula.plans import table_queries as tq
from granula.plans import voxel_queries as vq
from granula.plans.voxel_queries import I3, SX, SY, SZ, VX, S, V, rounded, vox

t = tq.t
REACH = 0.16


def voxel_contacts(spark, sf_dir):
    """Pairs of mitochondria by their nearest voxels."""
    return rounded(bricks.gaps(vox(spark, sf_dir).where("entity = 'mito'"), S, REACH))


def contact_order(spark, sf_dir):
    """Contacts numbered in the order of a report within each object."""
    from pyspark.sql import Window as W

    found = bricks.gaps(vox(spark, sf_dir).where("entity = 'mito'"), S, REACH)
    return found.select("object_id", "label_a", "label_b", F.row_number().over(W.partitionBy("object_id").orderBy("entity", "label_a", "label_b", "gap_um")).alias("place"))


def voxel_components_faces(spark, sf_dir):
    return graph.voxel_components(vox(spark, sf_dir).where("entity = 'mito'").withColumn("label", F.lit(1)), full=False, name="faces")


def equivalent_ellipsoid(spark, sf_dir):
    """Centre and diameters; the axes have no SQL and are tested on their own."""
    found = morphology.equivalent_ellipsoids(vox(spark, sf_dir), S)
    return rounded(found.select("object_id", "entity", "label", "z_um", "y_um", "x_um", F.element_at("diameters", 1).alias("d1"), F.element_at("diameters", 2).alias("d2"), F.element_at("diameters", 3).alias("d3")), 5)


def region_metrics(spark, sf_dir):
    found = morphology.region_metrics(vox(spark, sf_dir).where("entity <> 'mito'"), S)
    return rounded(found.select("object_id", "entity", "volume_um3", "surface_area_um2", "sphericity"), 5)


def carried_mask(spark, sf_dir):
    """The nucleus on a grid of 14 x 20 x 26 instead of 9 x 13 x 13."""
    coarse = vox(spark, sf_dir).where("entity = 'nucleus'").select("object_id", "z", "y", "x")
    shape = coarse.select("object_id").distinct().select("object_id", *[F.lit(n).alias(f"{k}{a}") for k, ns in (("n", (14, 20, 26)), ("c", (9, 13, 13))) for a, n in zip("zyx", ns, strict=True)])
    return rows.carried(coarse, shape)


def _instances(spark, sf_dir):
    v = iq.inst(spark, sf_dir)
    return v.select("object_id", F.col("entity").alias("instance_entity"), F.col("label").alias("instance_label"), F.col("size").alias("instance_volume_um3"), F.col("d5").alias("instance_sphericity"))


def geometry_metrics(spark, sf_dir):
    return rounded(rows.with_metrics(iq.shown(spark, sf_dir).select("object_id", "entity_name", "row_type", "label"), _instances(spark, sf_dir).where("instance_label % 5 <> 0"), ["instance_volume_um3", "instance_sphericity"]))


def scene_metric(spark, sf_dir):
    wide = _instances(spark, sf_dir).withColumn("distance_to_7_um", F.when(F.col("instance_label") % 3 != 0, F.col("instance_sphericity") * 2))
    return rounded(rows.scene_metric(iq.shown(spark, sf_dir).where("object_id = 0"), wide, "distance_to_7_um"))


def _entities(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "label").otherwise("mask")
    return o.select(F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("entity_name"), kind.alias("entity_kind"))


def entity_presence(spark, sf_dir):
    return rows.entity_presence(_entities(spark, sf_dir))


def deep_row_kind(spark, sf_dir):
    """Rows by the kind of their entity, which only urgent and high ones of the object have."""
    entities = _entities(spark, sf_dir).where("entity_kind = 'label'").distinct()
    deep = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("instance_entity"), "o_totalprice")
    found = rows.with_kind(deep, entities, "instance_entity")
    return rounded(found.groupBy("entity_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def entity_extras(spark, sf_dir):
    extras = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("entity_name")).agg(F.max("o_totalprice").alias("polar_depth_um")).where("polar_depth_um > 200000")
    return rounded(rows.with_extras(_entities(spark, sf_dir).distinct(), extras), 2)


def overview(spark, sf_dir):
    """Customers as objects of two and three dimensions, their order priorities as structures, order lines as instances."""
    c = t(spark, sf_dir, "customer")
    objects = c.select(F.col("c_custkey").alias("object_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("group"), F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(3).alias("spatial_dims"))
    found = report.overview(objects, _entities(spark, sf_dir), t(spark, sf_dir, "lineitem"), "4-NOT SPECIFIED")
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return found.select("objects", "groups", "instances", F.array_join("structures", ",").alias("structures"), text("dims").alias("dims"), "mixed")


def entity_filter(spark, sf_dir):
    return rows.chosen_entities(_entities(spark, sf_dir), ["1-URGENT", "5-LOW"], "3-MEDIUM").groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"))


def file_facts(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    end = F.when(F.col("page_id") % 7 == 0, ".nii.gz").otherwise(".TIF")
    files = p.select((F.col("page_id") % 40).alias("object_id"), F.concat(F.lit("a/b.c/"), "page_id", end).alias("path"), F.length("html").alias("length"), F.col("page_id").alias("modified"))
    return rows.file_facts(files)


def memory_estimate(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalar.memory_estimate(F.col("p_partkey") * 1000, F.col("p_size")).alias("bytes"))


def voxel_size_source(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    pick = lambda n: F.when(F.col("p_partkey") % n == 0, F.col("p_retailprice") / n)
    found = p.select("p_partkey", pick(2).alias("c"), pick(3).alias("m"), pick(5).alias("h"))
    return rounded(found.select("p_partkey", *[v.alias(k) for k, v in rows.voxel_size_choice(F.col("c"), F.col("m"), F.col("h")).items()]))


def id_cast(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, "NaN").when(F.col("p_partkey") % 5 == 2, F.concat("p_partkey", F.lit(".0"))).otherwise(F.col("p_partkey").cast("string"))
    return p.select("p_partkey", scalar.id_cast(text).alias("label"))


def colour_ramp(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalar.ramp((F.col("p_size") - 1) / 49.0).alias("colour"))


def unit_vector(spark, sf_dir):
    u = iq.unit(spark, sf_dir)
    part = scalar.unit_vector(F.col("nz"), F.when(F.col("label") % 4 != 0, F.col("ny")), F.col("nx"))
    return rounded(u.select("label", part.isNull().alias("missing"), F.element_at(part, 1).alias("z"), F.element_at(part, 3).alias("x")))


def object_count(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("obs_level"), F.lit(1).alias("x"))
    return rows.object_count(o)


def _typed(spark, sf_dir):
    kinds = F.array(*map(F.lit, rows.ROW_TYPES))
    return t(spark, sf_dir, "orders").select(F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("row_type"), F.col("o_totalprice").alias("size"))


def row_dispatch(spark, sf_dir):
    """The report taken apart and counted again: no row is lost."""
    from functools import reduce

    parts = rows.adapted(_typed(spark, sf_dir))
    return rounded(reduce(lambda a, b: a.union(b), [p.agg(F.lit(k).alias("row_type"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")) for k, p in parts.items()]), 2)


def failure_split(spark, sf_dir):
    results = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("cannot read "), F.col("o_orderkey"))).alias("error"))
    good, bad = rows.split_failures(results)
    return bad.join(good.select("object_id"), "object_id", "left_anti")


def branches_or_null(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    key = F.col("p_partkey")
    found = rows.branch_values(key % 2 == 0, key % 3 != 0, F.when(key % 5 != 0, F.col("p_size")), F.when(key % 5 != 0, F.col("p_retailprice")))
    return rounded(p.select("p_partkey", *[v.alias(k) for k, v in found.items()]))


def reference_list(spark, sf_dir):
    """Structures by the objects that have an offset, numbered in their order."""
    from pyspark.sql import Window as W

    found = polarity.references(polarity.reference_offset(iq.unit(spark, sf_dir), ["object_id", "entity"]))
    return rounded(found.withColumn("place", F.row_number().over(W.orderBy(F.desc("n_objects"), F.round("offset_um", 9).desc(), "entity"))))


def signed_angle(spark, sf_dir):
    return rounded(polarity.signed_angles(iq.unit(spark, sf_dir)).select("label", "uz", "uy", "ux", "signed_deg"), 4)


def cell_points(spark, sf_dir):
    return rounded(polarity.cell_points(iq.unit(spark, sf_dir).withColumn("entity", F.col("entity").cast("string")), "3"), 4)


def wedge_share(spark, sf_dir):
    """Expected shares of 18 wedges beside the share of each structure's directions."""
    cone = polarity.cone_angles(iq.unit(spark, sf_dir)).withColumn("wedge", F.least(F.lit(17), F.floor(F.round(F.col("cone_deg"), 6) / 10)).cast("int"))
    seen = cone.groupBy("wedge").agg(F.count(F.lit(1)).alias("n"))
    return rounded(seen.select("wedge", "n", polarity.wedge_share(F.col("wedge") * 10.0, (F.col("wedge") + 1) * 10.0).alias("expected")))


def layout_morph(spark, sf_dir):
    u = polarity.signed_angles(polarity.cone_angles(iq.unit(spark, sf_dir)))
    out = [c.alias(f"{kind}_{k}") for kind in ("half", "circle", "cart", "unit") for k, c in polarity.layout(kind, F.col("cone_deg"), F.col("signed_deg"), F.col("dist"), 0.5).items()]
    return rounded(u.select("label", *out), 4)


def chance_curve(spark, sf_dir):
    return rounded(stats.chance_curve(tq._counts(spark, sf_dir), ["structure"], 24))


def drawn_curve(spark, sf_dir):
    """The share curve as it is drawn, in 20 steps."""
    return rounded(stats.share_curve(tq._ev(spark, sf_dir), ["structure"], "value", 20))


def extent_gap(spark, sf_dir):
    """The gap of an instance's own extent, and chance corrected for it."""
    found = vq.distance_min(spark, sf_dir)
    gap = stats.extent_gap(found, ["target"], "distance_um", "distance_mean_um")
    return rounded(gap.select("target", "extent_gap_um", stats.corrected_chance(F.lit(0.2), F.col("extent_gap_um")).alias("corrected_um")), 5)


def significance(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.pow(F.lit(10.0), -(F.col("p_partkey") % 6).cast("double")) / 2).alias("p"))
    return p.select("p_partkey", scalar.stars(F.col("p")).alias("stars"), stats.significance_label(F.col("p")).alias("label"))


def test_plan(spark, sf_dir):
    """Pairs of event types with one more group that has a single object."""
    lone = spark.range(1).select(F.lit("alone").alias("group"), F.lit(1.0).alias("value"))
    return stats.plan(tq._values(spark, sf_dir).unionByName(lone))


def untested_line(spark, sf_dir):
    """The line under the plot where small nations of suppliers cannot be tested; every nation is a group of its suppliers' balances."""
    s = t(spark, sf_dir, "supplier")
    return stats.untested_line(stats.plan(s.select(F.col("s_nationkey").cast("string").alias("group"), F.col("s_acctbal").alias("value"))))


def bracket_rungs(spark, sf_dir):
    return stats.rungs(stats.pairs(tq._values(spark, sf_dir).select("group").distinct()))


def geometry_owners(spark, sf_dir):
    """Objects of the files of two tables read as one."""
    from granula.operators import scene

    source = scene.source_of(spark, [f"{sf_dir}/supplier.parquet", f"{sf_dir}/nation.parquet"])
    found = scene.owners(source.select(F.coalesce("s_suppkey", F.col("n_nationkey") + 1000000).alias("object_id"), "filename"))
    return found.select("object_id", F.element_at(F.split("filename", "/"), -1).alias("file"))


def deep_columns(spark, sf_dir):
    """Contact rows read by the columns that readers use."""
    li = t(spark, sf_dir, "lineitem")
    report = li.select(
        F.lit("contact").alias("row_type"), F.col("l_orderkey").alias("object_id"), F.col("l_returnflag").alias("contact_entity"), F.col("l_partkey").alias("contact_label_a"),
        F.col("l_suppkey").alias("contact_label_b"), F.col("l_tax").alias("contact_gap_um"), F.col("l_shipdate").alias("unused"),
    )
    return rows.deep(report, "contact").groupBy("contact_entity").agg(F.count(F.lit(1)).alias("n"), F.max("contact_gap_um").alias("gap"))


def structure_colours(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("entity_name"), F.when(F.col("c_mktsegment") < "C", "#123456").alias("entity_colour"))
    return rows.structure_colours(c).select("entity_name", F.when(F.col("entity_name") < "C", F.col("colour")).alias("given"), F.length("colour").alias("n"))


EN = "en AS (SELECT o_custkey AS object_id, o_orderpriority AS entity_name, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'label' ELSE 'mask' END AS entity_kind FROM orders)"
GA = f"ga AS (SELECT a.object_id, a.entity, a.label AS label_a, b.label AS label_b, min(sqrt(power((a.z - b.z) * {SZ}::DOUBLE, 2) + power((a.y - b.y) * {SY}::DOUBLE, 2) + power((a.x - b.x) * {SX}::DOUBLE, 2))) AS gap_um FROM vox a JOIN vox b ON a.object_id = b.object_id AND a.entity = 'mito' AND b.entity = 'mito' AND a.label < b.label GROUP BY ALL HAVING min(sqrt(power((a.z - b.z) * {SZ}::DOUBLE, 2) + power((a.y - b.y) * {SY}::DOUBLE, 2) + power((a.x - b.x) * {SX}::DOUBLE, 2))) <= {REACH})"
_AX = "CASE WHEN least(abs(az), abs(ay), abs(ax)) = abs(az) THEN 'z' WHEN abs(ay) <= abs(ax) THEN 'y' ELSE 'x' END"
SG = f"{iq.U}, sg AS (SELECT *, degrees(acos(greatest(-1, least(1, ny * 0.6::DOUBLE + nx * 0.8::DOUBLE)))) AS cone, degrees(atan2(nz, ny * 0.6::DOUBLE + nx * 0.8::DOUBLE)) AS signed FROM u)"
_LAY = lambda kind, px, py: f"round(cone / 180 + ({px} - cone / 180) * 0.5, 4) AS {kind}_px, round(dist + ({py} - dist) * 0.5, 4) AS {kind}_py"
_STARS = "CASE WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"

SQL = {
    "voxel_contacts": f"{V}, {GA} SELECT object_id, entity, label_a, label_b, round(gap_um, 6) AS gap_um FROM ga",
    "contact_order": f"{V}, {GA} SELECT object_id, label_a, label_b, row_number() OVER (PARTITION BY object_id ORDER BY entity, label_a, label_b, gap_um) AS place FROM ga",
    "voxel_components_faces": f"{V}, {vq._COMP.replace('abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1', 'abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1')} SELECT object_id, 'mito' AS entity, z, y, x, component::INT AS component FROM k",
    "equivalent_ellipsoid": f"{V}, m AS ({vq._MOM3}), e AS (SELECT *, (zz + yy + xx) / 3 AS q FROM m), p AS (SELECT *, sqrt((power(zz - q, 2) + power(yy - q, 2) + power(xx - q, 2) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM e), d AS (SELECT *, (zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx) AS det FROM p), f AS (SELECT *, acos(greatest(-1, least(1, coalesce(det / nullif(2 * p * p * p, 0), 1)))) / 3 AS phi FROM d), l AS (SELECT *, q + 2 * p * cos(phi) AS l3, q + 2 * p * cos(phi + 2 * pi() / 3) AS l1 FROM f), r AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM l), c AS (SELECT {I3}, avg(z) * {SZ} AS cz, avg(y) * {SY} AS cy, avg(x) * {SX} AS cx FROM vox GROUP BY ALL), g2 AS (SELECT {I3}, cz, cy, cx, l1, l2, l3 FROM r JOIN c USING ({I3})) SELECT {I3}, round(cz, 5) AS z_um, round(cy, 5) AS y_um, round(cx, 5) AS x_um, {', '.join(f'round(CASE WHEN l{k} > 1e-12 THEN 2 * sqrt(5 * l{k}) ELSE 0 END, 5) AS d{k}' for k in (1, 2, 3))} FROM g2",
    "region_metrics": f"{V}, s AS ({vq._SURF}), n AS (SELECT {I3}, count(*) * {VX!r}::DOUBLE AS v FROM vox GROUP BY ALL) SELECT object_id, entity, round(v, 5) AS volume_um3, round(s, 5) AS surface_area_um2, round(cbrt(36 * pi() * v * v) / s, 5) AS sphericity FROM s JOIN n USING ({I3}) WHERE entity <> 'mito'",
    "carried_mask": f"{V} SELECT object_id, z.z, y.y, x.x FROM vox v, (SELECT unnest(range(14))::INT AS z) z, (SELECT unnest(range(20))::INT AS y) y, (SELECT unnest(range(26))::INT AS x) x WHERE v.entity = 'nucleus' AND z.z * 9 // 14 = v.z AND y.y * 13 // 20 = v.y AND x.x * 13 // 26 = v.x",
    "geometry_metrics": f"{iq.SH} SELECT object_id, entity AS entity_name, row_type, label, round(CASE WHEN label % 5 <> 0 THEN size END, 6) AS volume_um3, round(CASE WHEN label % 5 <> 0 THEN d5 END, 6) AS sphericity FROM s JOIN i USING (object_id, entity, label, size)",
    "scene_metric": f"{iq.B} SELECT object_id, entity AS entity_name, label, round(d5 * 2, 6) AS value FROM i WHERE object_id = 0 AND label % 3 <> 0",
    "entity_presence": f"WITH {EN} SELECT entity_kind, entity_name, count(DISTINCT object_id) AS objects FROM en GROUP BY ALL",
    "deep_row_kind": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'label' END AS entity_kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "entity_extras": f"WITH {EN} SELECT DISTINCT object_id, entity_name, entity_kind, round(x.polar_depth_um, 2) AS polar_depth_um FROM en LEFT JOIN (SELECT o_custkey AS object_id, o_orderpriority AS entity_name, max(o_totalprice) AS polar_depth_um FROM orders GROUP BY ALL HAVING max(o_totalprice) > 200000) x USING (object_id, entity_name)",
    "overview": f"WITH {EN}, k AS (SELECT entity_name, max((entity_kind = 'label')::INT) AS label FROM en GROUP BY 1), d AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS dims, count(*) AS n FROM customer GROUP BY 1) SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS objects, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment <> 'BUILDING') AS groups, (SELECT count(*) FROM lineitem) AS instances, (SELECT string_agg(entity_name, ',' ORDER BY entity_name <> '4-NOT SPECIFIED', label, entity_name) FROM k) AS structures, (SELECT string_agg(dims || ':' || n, ',' ORDER BY dims) FROM d) AS dims, (SELECT count(*) > 1 FROM d) AS mixed",
    "entity_filter": f"WITH {EN} SELECT entity_name, count(*) AS n FROM en WHERE entity_name IN ('1-URGENT', '5-LOW', '3-MEDIUM') GROUP BY ALL",
    "file_facts": "SELECT page_id % 40 AS object_id, sum(length(html))::BIGINT AS size_bytes, max(page_id) AS modification_date, CASE WHEN count(DISTINCT page_id % 7 = 0) = 1 THEN CASE WHEN bool_and(page_id % 7 = 0) THEN '.nii.gz' ELSE '.tif' END END AS file_extension FROM pages GROUP BY 1",
    "memory_estimate": "SELECT p_partkey, floor(p_partkey * 1000 * (2 * p_size + 4) * 3.5)::BIGINT AS bytes FROM part",
    "voxel_size_source": "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 2 WHEN p_partkey % 3 = 0 THEN p_retailprice / 3 WHEN p_partkey % 5 = 0 THEN p_retailprice / 5 END, 6) AS voxel_size, CASE WHEN p_partkey % 2 = 0 THEN 'command line' WHEN p_partkey % 3 = 0 THEN 'manifest' WHEN p_partkey % 5 = 0 THEN 'header' END AS voxel_size_source FROM part",
    "id_cast": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_partkey END AS label FROM part",
    "colour_ramp": "SELECT p_partkey, '#' || printf('%02x', round(255 * (1 - (p_size - 1) / 49.0))::INT) || printf('%02x', round(255 * ((p_size - 1) / 49.0))::INT) || 'ff' AS colour FROM part",
    "unit_vector": f"{iq.U} SELECT label, label % 4 = 0 AS missing, CASE WHEN label % 4 <> 0 THEN round(nz, 6) END AS z, CASE WHEN label % 4 <> 0 THEN round(nx, 6) END AS x FROM u",
    "object_count": "SELECT count(*) AS objects FROM orders WHERE o_orderkey % 3 = 0",
    "row_dispatch": "SELECT ['object', 'entity', 'instance', 'distance', 'contact', 'baseline'][o_orderkey % 6 + 1] AS row_type, count(*) AS n, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1",
    "failure_split": "SELECT o_orderkey AS object_id, 'cannot read ' || o_orderkey AS error FROM orders WHERE o_orderstatus = 'F'",
    "branches_or_null": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 0 END END AS instance_branches, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice, 6) ELSE 0 END END AS instance_length_um FROM part",
    "reference_list": f"{iq.U}, o AS (SELECT object_id, entity, sum(w * nz * dist) / sum(w) AS oz, sum(w * ny * dist) / sum(w) AS oy, sum(w * nx * dist) / sum(w) AS ox FROM u GROUP BY ALL), l AS (SELECT entity, sqrt(oz*oz + oy*oy + ox*ox) AS l FROM o), r AS (SELECT entity, count(*) AS n_objects, avg(l) AS offset_um FROM l WHERE l > 1e-12 GROUP BY ALL) SELECT entity, n_objects, round(offset_um, 6) AS offset_um, row_number() OVER (ORDER BY n_objects DESC, round(offset_um, 9) DESC, entity) AS place FROM r",
    "signed_angle": f"{SG} SELECT label, 1::DOUBLE AS uz, 0::DOUBLE AS uy, 0::DOUBLE AS ux, round(signed, 4) AS signed_deg FROM sg",
    "cell_points": f"{iq.U}, m AS (SELECT object_id, entity::VARCHAR AS entity, sum(w * nz) / sum(w) AS mz, sum(w * ny) / sum(w) AS my, sum(w * nx) / sum(w) AS mx FROM u WHERE entity <> 3 GROUP BY ALL), r AS (SELECT *, sqrt(mz*mz + my*my + mx*mx) AS r FROM m) SELECT object_id, entity, round(CASE WHEN r > 1e-12 THEN degrees(acos(greatest(-1, least(1, (my * 0.6::DOUBLE + mx * 0.8::DOUBLE) / r)))) END, 4) AS cone_deg, round(r, 4) AS r FROM r",
    "wedge_share": f"{SG} SELECT least(17, floor(round(cone, 6) / 10))::INT AS wedge, count(*) AS n, round((cos(radians(least(17, floor(round(cone, 6) / 10)) * 10)) - cos(radians((least(17, floor(round(cone, 6) / 10)) + 1) * 10))) / 2, 6) AS expected FROM sg GROUP BY ALL",
    "layout_morph": f"{SG} SELECT label, {_LAY('half', 'dist * cos(radians(cone))', 'dist * sin(radians(cone))')}, {_LAY('circle', 'dist * cos(radians(signed))', 'dist * sin(radians(signed))')}, {_LAY('cart', 'dist * sin(radians(signed))', 'dist * cos(radians(signed))')}, {_LAY('unit', 'cos(radians(signed))', 'sin(radians(signed))')} FROM sg",
    "chance_curve": f"{tq.CN}, h AS (SELECT structure, min(bin) * 20::DOUBLE AS low, (max(bin) + 1) * 20::DOUBLE AS high FROM c GROUP BY 1), b AS (SELECT *, greatest(4, least(24, round((high - low) / 20)))::INT AS bins FROM h), m AS (SELECT c.structure, low, (high - low) / bins AS width, least(bins - 1, floor(((bin + 0.5) * 20 - low) / ((high - low) / bins)))::INT AS to_bin, sum(n) AS n FROM c JOIN b USING (structure) GROUP BY ALL) SELECT structure, to_bin, round(low, 6) AS low, round(width, 6) AS width, round(n / sum(n) OVER (PARTITION BY structure) / width, 6) AS density FROM m",
    "drawn_curve": f"WITH {tq.EV}, c AS (SELECT structure, value, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT structure, value, 100 * sum(n) OVER (PARTITION BY structure ORDER BY value) / sum(n) OVER (PARTITION BY structure) AS percent FROM c), s AS (SELECT *, ceil(round(percent * 20 / 100, 9))::BIGINT AS step FROM p) SELECT structure, 0 AS step, min(value) AS value, 0.0 AS percent FROM p GROUP BY 1 UNION ALL SELECT structure, step, max(value), round(max(percent), 6) FROM s GROUP BY ALL",
    "extent_gap": f"{V}, {vq._dist_sql()}, {vq._MIN}, r AS (SELECT target, round(distance_um, 6) AS a, round(distance_mean_um, 6) AS b FROM d), g2 AS (SELECT target, median(b - a) AS g FROM r GROUP BY 1) SELECT target, round(g, 5) AS extent_gap_um, round(greatest(0, 0.2 - g), 5) AS corrected_um FROM g2",
    "significance": f"WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN power(10.0, -(p_partkey % 6)) / 2 END AS p FROM part) SELECT p_partkey, {_STARS} AS stars, CASE WHEN p IS NULL THEN 'untested' ELSE {_STARS} || ' · ' || CASE WHEN p < 1e-4 THEN 'p < 0.0001' ELSE 'p = ' || printf('%.4f', p) END END AS label FROM q",
    "test_plan": f"WITH {tq.EV}, v AS (SELECT structure AS g, object_id FROM e GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM v GROUP BY g UNION ALL SELECT 'alone', 1) SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, CASE WHEN a.n < 2 AND b.n < 2 THEN '1 object in both groups' WHEN a.n < 2 THEN '1 object in ' || a.g WHEN b.n < 2 THEN '1 object in ' || b.g END AS reason FROM n a JOIN n b ON a.g < b.g",
    "untested_line": "WITH n AS (SELECT s_nationkey::VARCHAR AS g, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT a.n AS na, b.n AS nb FROM n a JOIN n b ON a.g < b.g WHERE (SELECT max(n) FROM n) > 1) SELECT (SELECT 'not tested: ' || string_agg(g || ' (1 object)', ', ' ORDER BY g || ' (1 object)') FROM n WHERE n < 2 AND EXISTS (SELECT 1 FROM p)) AS line, count(*) FILTER (na > 1 AND nb > 1) + (count(*) FILTER (na < 2 OR nb < 2) > 0)::BIGINT AS rungs FROM p",
    "bracket_rungs": f"WITH {tq.EV}, n AS (SELECT structure AS g, row_number() OVER (ORDER BY structure) AS k FROM e GROUP BY 1) SELECT a.g AS group_a, b.g AS group_b, row_number() OVER (ORDER BY b.k - a.k, a.k) AS rung FROM n a JOIN n b ON a.g < b.g",
    "geometry_owners": "SELECT s_suppkey AS object_id, 'supplier.parquet' AS file FROM supplier UNION SELECT n_nationkey + 1000000, 'nation.parquet' FROM nation",
    "deep_columns": "SELECT l_returnflag AS contact_entity, count(*) AS n, max(l_tax) AS gap FROM lineitem GROUP BY 1",
    "structure_colours": "SELECT DISTINCT c_mktsegment AS entity_name, CASE WHEN c_mktsegment < 'C' THEN '#123456' END AS given, 7 AS n FROM customer",
}
QUERIES = {name: globals()[name] for name in SQL}
