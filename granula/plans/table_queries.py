"""Queries over the order, event and page tables read as report rows, with SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.functions import scalar
from granula.operators import report, stats
from granula.plans.voxel_queries import rounded
from granula.sources import discovery
from granula.streaming import resume


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MASTER = T.StructType([T.StructField("row_type", T.StringType()), T.StructField("object_id", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("n", T.DoubleType()), T.StructField("comment", T.StringType())])


def _union(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.lit("object").alias("row_type"), F.col("o_orderkey").alias("object_id"), F.col("o_totalprice").alias("size"))
    s = t(spark, sf_dir, "supplier").select(F.lit("entity").alias("row_type"), F.col("s_suppkey").alias("object_id"), F.col("s_nationkey").alias("n"))
    return report.typed_union([o, s], MASTER)


def typed_union(spark, sf_dir):
    return _union(spark, sf_dir)


def drop_empty_columns(spark, sf_dir):
    return report.drop_empty_columns(_union(spark, sf_dir))


def float32_narrowing(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return scalar.narrowed(rows).select("s_suppkey", F.col("s_acctbal").cast("double").alias("narrow"))


def null_non_finite(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return scalar.finite_columns(rows).agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"))


def row_rollup(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("instance_count"), F.col("l_returnflag").alias("entity_name"))
    return report.roll_up(li, "l_orderkey", ["instance_count"], ["entity_name"])


def deep_row_group(spark, sf_dir):
    li, o = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").groupBy(F.col("o_orderpriority").alias("group"), F.col("l_returnflag").alias("entity"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


def orphan_distances(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    o = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"))
    return report.orphans(li, o, ["k"]).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def orphan_contacts(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return li.join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_anti")


def contact_ends(spark, sf_dir):
    """Distinct numbers on either end of a pair."""
    li = t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("label")).union(li.select("l_suppkey")).distinct()


def missing_structures(spark, sf_dir):
    """Order priorities that a customer never used."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("structure"))
    objects = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"))
    return report.missing_structures(o.distinct(), objects, o.select("structure").distinct())


def resume_split(spark, sf_dir):
    """A third of the objects has a part, of which every other one is stale; the parts are the test's given state and not a cut."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_key"), scalar.digest(F.col("o_orderstatus"), F.lit(1)).alias("fingerprint"))
    parts = o.where("object_key % 3 = 0").withColumn("fingerprint", F.when(F.col("object_key") % 2 == 0, F.col("fingerprint")).otherwise("stale"))
    return resume.remaining(o, parts).select(F.col("object_key").alias("object_id"), "fingerprint")


def settings_digest(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalar.digest(F.col("p_name"), F.col("p_size"), F.lit(None)).alias("digest"))


def overview_counts(spark, sf_dir):
    li, o = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders")
    a = o.agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("o_orderpriority").alias("groups"))
    return a.join(F.broadcast(li.agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("l_returnflag").alias("structures"))))


def coverage(spark, sf_dir):
    li, o = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders")
    have = li.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("present"))
    return have.join(F.broadcast(o.agg(F.count(F.lit(1)).alias("objects")))).select(F.col("l_returnflag").alias("structure"), "present", "objects")


def composition_share(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    parts = li.groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_returnflag").alias("structure")).agg(F.sum("l_quantity").alias("size"))
    whole = li.groupBy(F.col("l_orderkey").alias("object_id")).agg((F.sum("l_quantity") * 2).alias("total"))
    names = li.select(F.col("l_returnflag").alias("structure")).distinct()
    return rounded(report.composition(parts, whole, names, "object_id"))


def recolour(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("entity_name"))
    return report.recoloured(rows, {"MACHINERY": "#ff0000", "HOUSEHOLD": "#00ff00"})


def describe_noun(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("objects per object of "), "p_name", F.lit(" objection")).alias("text"))
    return rows.select("p_partkey", scalar.noun(F.col("text"), "cell").alias("text"))


def _files(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    stem = F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), 4)
    kind = F.when(F.col("page_id") % 3 == 0, "_label").when(F.col("page_id") % 3 == 1, "_MASK").otherwise("_raw")
    return p.select("page_id", (F.col("page_id") % 40).alias("dir"), F.concat(stem, F.lit("-Part "), (F.col("page_id") % 7).cast("string"), kind).alias("stem"), F.length("html").alias("size"))


def kind_suffix(spark, sf_dir):
    body, kind = scalar.kind_suffix(F.col("stem"))
    return _files(spark, sf_dir).select("page_id", body.alias("body"), kind.alias("kind"))


def normalize_name(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", scalar.normal_name(F.col("stem")).alias("name"))


def entity_name(spark, sf_dir):
    """Names after the longest prefix shared with the first file of the folder; null when nothing is left."""
    rows = _files(spark, sf_dir).withColumn("source", F.min("stem").over(W.partitionBy("dir")))
    shared = scalar.shared_prefix(F.col("stem"), F.col("source"))
    return rows.withColumn("n", shared).select("page_id", "n", F.nullif(scalar.normal_name(F.expr("substring(stem, n + 1)")), F.lit("")).alias("entity_name"))


def source_choice(spark, sf_dir):
    """In each folder the file with the greatest sum of shared prefixes, then the largest, then the first."""
    rows = _files(spark, sf_dir).select("dir", "page_id", "stem", "size")
    several = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dir")
    scored = rows.join(several, "dir", "left_semi").join(discovery.prefix_scores(rows), ["dir", "stem"])
    order = W.partitionBy("dir").orderBy(F.desc("score"), F.desc("size"), "page_id")
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("dir", "page_id", "score")


def group_label(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return t(spark, sf_dir, "pages").select("page_id", report.group_label(path, ["therha.example.com/en", "thther.example.org"]).alias("group"))


def _ev(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("structure"), F.round("value", 2).alias("value"))


def share_curve(spark, sf_dir):
    return rounded(stats.ecdf(_ev(spark, sf_dir), ["structure"], "value"))


def shared_histogram(spark, sf_dir):
    return rounded(stats.shared_histogram(_ev(spark, sf_dir), "structure", "value", 24))


def _counts(spark, sf_dir):
    rows = _ev(spark, sf_dir)
    bin_ = F.least(F.lit(9), F.floor(F.col("value") / 20)).cast("int")
    return rows.groupBy("structure", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns({"lo": F.lit(0.0), "width": F.lit(20.0)})


def median_of_counts(spark, sf_dir):
    return rounded(stats.median_of_counts(_counts(spark, sf_dir), ["structure"]))


def rebin_histogram(spark, sf_dir):
    return rounded(stats.rebinned(_counts(spark, sf_dir), ["structure"], 0.0, 50.0, 4))


def pooled_chance(spark, sf_dir):
    """Chance of each structure from all objects (pooled counts) and of each object on its own (its plain median)."""
    rows = _ev(spark, sf_dir)
    facets = rows.withColumn("facet", F.explode(F.array(F.col("structure"), F.concat_ws(":", "structure", "object_id"))))
    bin_ = F.least(F.lit(9), F.floor(F.col("value") / 20)).cast("int")
    counts = facets.groupBy("facet", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns({"lo": F.lit(0.0), "width": F.lit(20.0)})
    return rounded(stats.chance_values(facets, ["facet"], "object_id", "value", counts).select("facet", "chance_um"))


def object_medians(spark, sf_dir):
    return rounded(stats.object_medians(_ev(spark, sf_dir), ["structure", "object_id"], "value"))


def _medians(rows):
    """One median per object (user), objects dealt to groups by structure."""
    return stats.object_medians(rows, ["structure", "object_id"], "value").select(F.col("structure").alias("group"), F.round("value", 3).alias("value"))


def _values(spark, sf_dir):
    return _medians(_ev(spark, sf_dir))


def mann_whitney_u(spark, sf_dir):
    return stats.rank_sums(_values(spark, sf_dir)).select("group_a", "group_b", "n_a", "n_b", "u", "ties")


def p_min(spark, sf_dir):
    return rounded(stats.p_floor(stats.rank_sums(_values(spark, sf_dir))).select("group_a", "group_b", "p_min", "floor"), 9)


def effect_delta(spark, sf_dir):
    return rounded(stats.effect(_values(spark, sf_dir)))


def hodges_lehmann(spark, sf_dir):
    return rounded(stats.shift(_values(spark, sf_dir)), 5)


def pairwise_plan(spark, sf_dir):
    return stats.pairs(_values(spark, sf_dir).select("group").distinct())


def mann_whitney_p(spark, sf_dir):
    return rounded(stats.mann_whitney(_values(spark, sf_dir)).select("group_a", "group_b", "n_a", "n_b", "u", "p"))


def _statuses(spark, sf_dir):
    """Orders of each customer, grouped by status; prices in ten thousands, so that many tie."""
    o = t(spark, sf_dir, "orders")
    return o.select("o_custkey", F.col("o_orderstatus").alias("group"), F.round(F.col("o_totalprice") / 10000).alias("value"))


def exact_rank_test(spark, sf_dir):
    """Rank tests within each customer: thousands of small samples with ties."""
    return rounded(stats.mann_whitney(_statuses(spark, sf_dir), ["o_custkey"], name="exact").where("method <> 'asymptotic'"))


def small_shifts(spark, sf_dir):
    """Shifts within each customer between its order statuses."""
    return rounded(stats.shift(_statuses(spark, sf_dir), ["o_custkey"]))


EV = "e AS (SELECT user_id AS object_id, event_type AS structure, round(value, 2) AS value FROM events)"
CN = f"WITH {EV}, c AS (SELECT structure, least(9, floor(value / 20))::INT AS bin, count(*) AS n FROM e GROUP BY ALL)"
MD = "m AS (SELECT structure, (bin + (half - (cum - n)) / n) * 20.0 AS median FROM (SELECT *, sum(n) OVER (PARTITION BY structure ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY structure) / 2 AS half FROM c) WHERE cum >= half QUALIFY row_number() OVER (PARTITION BY structure ORDER BY bin) = 1)"
#: The exact p of every pair of a customer's order statuses: counts of rank sums by pattern of ties, value by value.
EXACT_SQL = """
WITH RECURSIVE v AS (SELECT o_custkey, o_orderstatus AS g, round(o_totalprice / 10000) AS x FROM orders),
n AS (SELECT o_custkey, g, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT a.o_custkey, a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.g < b.g),
u AS (SELECT p.*, (SELECT sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) FROM v a JOIN v b ON a.o_custkey = p.o_custkey AND b.o_custkey = p.o_custkey AND a.g = group_a AND b.g = group_b)::DOUBLE AS u FROM p),
k AS (SELECT p.o_custkey, group_a, group_b, n_a, x, count(*) AS m FROM p JOIN v ON v.o_custkey = p.o_custkey AND v.g IN (group_a, group_b) WHERE n_a >= 2 AND n_b >= 2 AND n_a + n_b <= 20 GROUP BY ALL),
t AS (SELECT o_custkey, group_a, group_b, n_a, list(m ORDER BY x) AS tied FROM k GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT DISTINCT tied, n_a FROM t),
r AS (SELECT tied, n_a, unnest(flatten(list_transform(range(1, len(tied) + 1), lambda j: list_transform(range(tied[j]), lambda z: 2 * coalesce(list_sum(tied[1:j - 1]), 0)::BIGINT + tied[j] + 1)))) AS r FROM d),
i AS (SELECT tied, n_a, r::BIGINT AS r, row_number() OVER (PARTITION BY tied, n_a ORDER BY r) AS i FROM r),
w AS (SELECT tied, n_a, 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS s, 1::DOUBLE AS ways FROM d
  UNION ALL SELECT w.tied, w.n_a, i.i, w.c + b.b, w.s + b.b * i.r, sum(ways) FROM w JOIN i ON i.tied = w.tied AND i.n_a = w.n_a AND i.i = w.i + 1 JOIN (VALUES (0::BIGINT), (1::BIGINT)) b(b) ON w.c + b.b <= w.n_a GROUP BY ALL),
f AS (SELECT tied, n_a, s, ways FROM w WHERE c = n_a AND i = list_sum(tied)),
o AS (SELECT t.*, n_b, u, 2 * u + t.n_a * (t.n_a + 1) AS r2, t.n_a * (t.n_a + n_b + 1) AS mid FROM t JOIN u USING (o_custkey, group_a, group_b))
SELECT o_custkey, group_a, group_b, any_value(o.n_a) AS n_a, any_value(n_b) AS n_b, any_value(u) AS u, round(sum(ways) FILTER (abs(s - mid) >= abs(r2 - mid) - 1e-9) / sum(ways), 6) AS p, CASE WHEN any_value(list_max(o.tied)) > 1 THEN 'permutation' ELSE 'exact' END AS method
FROM o JOIN f ON f.tied = o.tied AND f.n_a = o.n_a GROUP BY ALL
"""
VA = f"WITH {EV}, v AS (SELECT structure AS g, round(median(value), 3) AS x FROM e GROUP BY structure, object_id), n AS (SELECT g, count(*) AS n FROM v GROUP BY g), p AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.g < b.g), uu AS (SELECT group_a, group_b, n_a, n_b, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM p JOIN v a ON a.g = group_a JOIN v b ON b.g = group_b GROUP BY ALL)"
TI = "t AS (SELECT group_a, group_b, sum(k * (k * k - 1))::DOUBLE AS ties FROM (SELECT group_a, group_b, x, count(*)::DOUBLE AS k FROM p JOIN v ON v.g IN (group_a, group_b) GROUP BY ALL) GROUP BY ALL)"
FI = "f AS (SELECT page_id, page_id % 40 AS dir, string_split(regexp_replace(url, '[?#].*$', ''), '/')[4] || '-Part ' || (page_id % 7) || CASE page_id % 3 WHEN 0 THEN '_label' WHEN 1 THEN '_MASK' ELSE '_raw' END AS stem, length(html) AS size FROM pages)"
NN = "nullif(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
SP = "(SELECT coalesce(min(k) FILTER ({a}[k] <> {b}[k]) - 1, least(length({a}), length({b}))) FROM range(1, least(length({a}), length({b})) + 1) r(k))"

SQL = {
    "typed_union": "SELECT 'object' AS row_type, o_orderkey::VARCHAR AS object_id, o_totalprice AS size, NULL::DOUBLE AS n, NULL::VARCHAR AS comment FROM orders UNION ALL SELECT 'entity', s_suppkey::VARCHAR, NULL, s_nationkey::DOUBLE, NULL FROM supplier",
    "drop_empty_columns": "SELECT 'object' AS row_type, o_orderkey::VARCHAR AS object_id, o_totalprice AS size, NULL::DOUBLE AS n FROM orders UNION ALL SELECT 'entity', s_suppkey::VARCHAR, NULL, s_nationkey::DOUBLE FROM supplier",
    "float32_narrowing": "SELECT s_suppkey, s_acctbal::FLOAT::DOUBLE AS narrow FROM supplier",
    "null_non_finite": "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0",
    "row_rollup": "SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS instance_count, CASE WHEN count(*) = 1 THEN min(l_returnflag) END AS entity_name FROM lineitem GROUP BY l_orderkey",
    "deep_row_group": 'SELECT o_orderpriority AS "group", l_returnflag AS entity, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL',
    "orphan_distances": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') GROUP BY ALL",
    "orphan_contacts": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)",
    "contact_ends": "SELECT l_partkey AS label FROM lineitem UNION SELECT l_suppkey FROM lineitem",
    "missing_structures": "SELECT c_custkey AS object_id, structure FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS structure FROM orders) s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = structure)",
    "resume_split": "SELECT o_orderkey AS object_id, left(sha256(o_orderstatus || '|1'), 16) AS fingerprint FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)",
    "settings_digest": "SELECT p_partkey, left(sha256(p_name || '|' || p_size || '|null'), 16) AS digest FROM part",
    "overview_counts": "SELECT * FROM (SELECT count(*) AS objects, count(DISTINCT o_orderpriority) AS groups FROM orders), (SELECT count(*) AS instances, count(DISTINCT l_returnflag) AS structures FROM lineitem)",
    "coverage": "SELECT l_returnflag AS structure, count(DISTINCT l_orderkey) AS present, (SELECT count(*) FROM orders) AS objects FROM lineitem GROUP BY ALL",
    "composition_share": "WITH l AS (SELECT l_orderkey AS object_id, l_returnflag AS structure, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), w AS (SELECT object_id, sum(q) * 2 AS total FROM l GROUP BY 1), s AS (SELECT DISTINCT structure FROM l), c AS (SELECT w.object_id, s.structure, 100 * coalesce(q, 0) / total AS percent FROM w CROSS JOIN s LEFT JOIN l ON l.object_id = w.object_id AND l.structure = s.structure) SELECT object_id, structure, round(percent, 6) AS percent FROM c UNION ALL SELECT object_id, 'remainder', round(100 - sum(percent), 6) FROM c GROUP BY 1",
    "recolour": "SELECT c_custkey, c_mktsegment AS entity_name, CASE c_mktsegment WHEN 'MACHINERY' THEN '#ff0000' WHEN 'HOUSEHOLD' THEN '#00ff00' END AS entity_colour FROM customer",
    "describe_noun": "SELECT p_partkey, 'cells per cell of ' || p_name || ' objection' AS text FROM part",
    "kind_suffix": f"WITH {FI} SELECT page_id, regexp_replace(stem, '_(label|MASK)$', '') AS body, CASE page_id % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'mask' END AS kind FROM f",
    "normalize_name": f"WITH {FI} SELECT page_id, coalesce({NN.format('stem')}, '') AS name FROM f",
    "entity_name": f"WITH {FI}, s AS (SELECT *, min(stem) OVER (PARTITION BY dir) AS source FROM f), n AS (SELECT *, {SP.format(a='stem', b='source')}::INT AS n FROM s) SELECT page_id, n, {NN.format('substr(stem, n + 1)')} AS entity_name FROM n",
    "source_choice": f"WITH {FI}, p AS (SELECT a.dir, a.page_id, a.size, a.stem AS s1, b.stem AS s2 FROM f a JOIN f b ON a.dir = b.dir AND a.page_id <> b.page_id), q AS (SELECT dir, page_id, size, {SP.format(a='s1', b='s2')} AS n FROM p), s AS (SELECT dir, page_id, size, sum(n)::BIGINT AS score FROM q GROUP BY ALL) SELECT dir, page_id, score FROM s QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, size DESC, page_id) = 1",
    "group_label": "WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages) SELECT page_id, CASE WHEN p = 'therha.example.com/en' OR starts_with(p, 'therha.example.com/en/') THEN 'therha.example.com/en' WHEN p = 'thther.example.org' OR starts_with(p, 'thther.example.org/') THEN 'thther.example.org' WHEN contains(p, '/') THEN string_split(p, '/')[1] ELSE '' END AS \"group\" FROM u",
    "share_curve": f"WITH {EV}, c AS (SELECT structure, value, count(*) AS n FROM e GROUP BY ALL) SELECT structure, value, round(100 * sum(n) OVER (PARTITION BY structure ORDER BY value) / sum(n) OVER (PARTITION BY structure), 6) AS percent FROM c",
    "shared_histogram": f"WITH {EV}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM e), c AS (SELECT structure, least(23, floor((value - lo) / (hi - lo) * 24))::INT AS bin, count(*) AS n FROM e, m GROUP BY ALL) SELECT structure, bin, round(100 * n / sum(n) OVER (PARTITION BY structure), 6) AS percent FROM c",
    "median_of_counts": f"{CN}, {MD} SELECT structure, round(median, 6) AS median FROM m",
    "rebin_histogram": f"{CN}, r AS (SELECT structure, least(3, floor((bin + 0.5) * 20 / 50))::INT AS to_bin, sum(n) AS n FROM c GROUP BY ALL) SELECT structure, to_bin, round(n / sum(n) OVER (PARTITION BY structure) / 50, 6) AS density FROM r",
    "pooled_chance": f"WITH {EV}, f AS (SELECT structure AS facet, object_id, value FROM e UNION ALL SELECT structure || ':' || object_id, object_id, value FROM e), c AS (SELECT facet AS structure, least(9, floor(value / 20))::INT AS bin, count(*) AS n FROM f GROUP BY ALL), {MD}, o AS (SELECT facet, count(DISTINCT object_id) AS k, median(value) AS own FROM f GROUP BY 1) SELECT facet, round(CASE WHEN k > 1 THEN median ELSE own END, 6) AS chance_um FROM o JOIN m ON structure = facet",
    "exact_rank_test": EXACT_SQL,
    "small_shifts": "WITH v AS (SELECT o_custkey, o_orderstatus AS g, round(o_totalprice / 10000) AS x FROM orders) SELECT a.o_custkey, a.g AS group_a, b.g AS group_b, round(median(a.x - b.x), 6) AS shift FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.g < b.g GROUP BY ALL",
    "object_medians": f"WITH {EV} SELECT structure, object_id, round(median(value), 6) AS value FROM e GROUP BY ALL",
    "mann_whitney_u": f"{VA}, {TI} SELECT uu.*, ties FROM uu JOIN t USING (group_a, group_b)",
    "mann_whitney_p": f"{VA}, {TI}, z AS (SELECT uu.*, greatest(0, abs(u - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) / sqrt(2) AS x FROM uu JOIN t USING (group_a, group_b)) SELECT group_a, group_b, n_a, n_b, u, round(CASE WHEN x = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * (SELECT sum(exp(-x * x + (2 * k + 1) * ln(x) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))) FROM range(200) r(k)) END, 6) AS p FROM z",
    "p_min": f"{VA}, m AS (SELECT group_a, group_b, least(1.0, 2 * exp(-(SELECT sum(ln((n_b + i)::DOUBLE / i)) FROM range(1, n_a + 1) r(i)))) AS p FROM p) SELECT group_a, group_b, round(p, 9) AS p_min, p >= 0.05 AS floor FROM m",
    "effect_delta": f"{VA} SELECT group_a, group_b, round((2 * u - n_a * n_b) / (n_a * n_b), 6) AS delta FROM uu",
    "hodges_lehmann": f"{VA} SELECT group_a, group_b, round(median(a.x - b.x), 5) AS shift FROM p JOIN v a ON a.g = group_a JOIN v b ON b.g = group_b GROUP BY ALL",
    "pairwise_plan": f"{VA} SELECT group_a, group_b FROM p",
}
QUERIES = {name: globals()[name] for name in SQL}
