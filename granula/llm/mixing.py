"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets: with sources sorted by capacity over weight, running sums give the one water level
at which every source takes weight * level words, or its capacity (maximum epochs times its
words) where that is less. That equals clamping and resharing until none is above, without
a loop. Documents: each source takes all its documents a whole number of times, then the
first documents in a seeded order until its target is met; the document on the border
gives the missing words, so a source misses its target by rounding alone.

The running sum over a source never meets in one task: documents fall into 256 x 256
buckets by the leading digits of their seeded hash. Bucket sums (combined before the
shuffle) decide all buckets but the one on the border, whose second level decides all but
one again; only the rows of that last bucket are ordered. The hash takes doc_id and text, so
null and repeated ids spread over the buckets, too.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of
its own and comes last; repeated rows count each time, and n equal rows on the border share
what is missing evenly (the target is missed by less than n words); an empty table gives an
empty result; a very long text is one row that may be taken in part; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.llm.base import drop_clashes, stored, table, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
RESULT = ["size", "source_size", "target", "taken"]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The weights repeat over the sources in code-point order, null last. Windows over all
    sources run on the aggregated rows only.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("__at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    everything = W.partitionBy().orderBy("__level", "__at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.partitionBy().orderBy("__level", "__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    capped = named.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__level", F.col("__cap") / F.col("__w"))
    summed = (
        capped.withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__caps", F.sum("__cap").over(upto))
        .withColumn("__rest", F.sum("__w").over(everything) - F.sum("__w").over(upto) + F.col("__w"))
    )
    # the level if all sources before this one are clamped; the first that stays below its capacity sets it for the rest
    level = (F.col("__total") - (F.col("__caps") - F.col("__cap"))) / F.col("__rest")
    tried = summed.withColumn("__try", level).withColumn("__free", F.col("__try") < F.col("__level"))
    water = F.first(F.when(F.col("__free"), F.col("__try")), ignorenulls=True).over(everything)
    target = F.when(F.col("__free"), F.col("__w") * F.col("__water")).otherwise(F.col("__cap"))
    return tried.withColumn("__water", water).select("source", "source_size", target.alias("target"))


def _below(sums: DataFrame, name: str) -> DataFrame:
    """Words of the buckets before each bucket of its source; a source has 256 buckets at most."""
    before = W.partitionBy("source").orderBy(name).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))


def mixed(
    df: DataFrame,
    size: Column | None = None,
    digest: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
    name: str = "mixing",
) -> DataFrame:
    """``df`` (with doc_id and source) with size, source_size, target and taken.

    ``size`` defaults to the words of ``text``, ``digest`` to its MD5. All columns are written
    to the shared folder and read again, so each is worked out once.
    """
    size = F.size(words_of(text_of())).cast("long") if size is None else size
    digest = F.md5(text_of()) if digest is None else digest
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))
    rows = drop_clashes(df.withColumn("__size", size), RESULT).withColumnRenamed("__size", "size").withColumn("__key", key)
    rows = stored(rows, name)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("__epochs", epochs).withColumn("__rest", F.round("target").cast("long") - F.col("__epochs") * F.col("source_size"))
    sources = stored(sources, f"{name}-sources")

    # two levels of buckets narrow the border of each source to a 65536th of its hash range
    one, two = F.substring("__key", 1, 2), F.substring("__key", 3, 2)
    sums = rows.groupBy("source", one.alias("__b1"), two.alias("__b2")).agg(F.sum("size").alias("words"))
    top = _below(sums.groupBy("source", "__b1").agg(F.sum("words").alias("words")), "__b1")
    edge1 = _border(_joined(top, sources.select("source", "__rest"))).select("source", F.col("__b1").alias("__e1"), F.col("before").alias("__before1"), "__rest")
    inner = _joined(sums, edge1).where(F.col("__b1") == F.col("__e1"))
    inner = _below(inner, "__b2").withColumn("before", F.col("before") + F.col("__before1"))
    edge2 = _border(inner).select("source", F.concat("__e1", "__b2").alias("__edge"), F.col("before").alias("__before"))
    plan = stored(_joined(sources, edge2, "left"), f"{name}-plan")

    full = _joined(rows, plan).withColumn("__four", F.substring("__key", 1, 4))
    at_edge = F.coalesce(F.col("__four") == F.col("__edge"), F.lit(False))
    # on the border equal rows count as one group, so the ordered rows are distinct however often they repeat
    edge = full.where(at_edge)
    groups = edge.groupBy("source", "__key", "size", "__rest", "__before").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy("source").orderBy("__key", "size").rowsBetween(W.unboundedPreceding, -1)
    missing = F.col("__rest") - F.col("__before") - F.coalesce(F.sum(F.col("size") * F.col("__n")).over(order), F.lit(0))
    share = F.floor(F.greatest(F.lit(0), F.least(F.col("size") * F.col("__n"), missing)) / F.col("__n"))
    groups = groups.select(F.col("source").alias("__s"), F.col("__key").alias("__k"), F.col("size").alias("__z"), share.alias("__extra"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k")) & (F.col("size") == F.col("__z"))
    edge = edge.join(groups, same).drop("__s", "__k", "__z")
    clear = full.where(~at_edge).withColumn("__extra", F.when(F.col("__four") < F.col("__edge"), F.col("size")).otherwise(F.lit(0)))
    out = edge.unionByName(clear).withColumn("taken", (F.col("__epochs") * F.col("size") + F.col("__extra")).cast("long"))
    return out.drop("__key", "__epochs", "__rest", "__edge", "__before", "__four", "__extra")


def _joined(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; one row per source on the right."""
    right = by_source.withColumnRenamed("source", "__s")
    return rows.join(right, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def _border(sums: DataFrame) -> DataFrame:
    return sums.where((F.col("before") < F.col("__rest")) & (F.col("before") + F.col("words") >= F.col("__rest")))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words with weights 5, 2, 1 and at most 2 epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = F.size(words_of(text_of())).cast("long")
    rows = docs.select("doc_id", "source", size.alias("words"), F.md5(text_of()).alias("digest"))
    return mixed(rows, F.col("words"), F.col("digest")).select("doc_id", "size", "source_size", "target", "taken")


#: The same level by running sums, and the seeded order as one running sum per source.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
c AS (SELECT *, [{", ".join(f"{w:.1f}::DOUBLE" for w in WEIGHTS)}][i % {len(WEIGHTS)} + 1] AS w, n * {MAX_EPOCHS:.1f}::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS level, (sum(n) OVER () * {SHARE}::DOUBLE - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS try FROM c
  WINDOW o AS (ORDER BY cap / w, i ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, n, CASE WHEN try < level THEN w * (SELECT arg_min(try, (level, i)) FROM r WHERE try < level) ELSE cap END AS target FROM r),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(round(target) / n)::BIGINT ELSE 0 END AS epochs FROM t),
h AS (SELECT source, k, size, count(*) AS times FROM d GROUP BY ALL),
g AS (SELECT *, (sum(times * size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - times * size)::BIGINT AS before FROM h),
f AS (SELECT d.doc_id, d.size, e.n AS source_size, e.target, epochs, times, before, round(target)::BIGINT - epochs * e.n AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.k = d.k AND g.size = d.size)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size * times, rest - before)) // times)::BIGINT AS taken FROM f
"""
