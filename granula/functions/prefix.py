"""Running sums over keys of any size, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import stored


def running_sums(rows: DataFrame, by: list[str], order: str, value: str, name: str = "running") -> DataFrame:
    """``rows`` (one for each ``by`` and ``order``) with ``below``, the sum of ``value`` at smaller ``order``, and ``total``.

    Rows are dealt by ranges of the order and written, so the number of a range stays; each
    range is summed on its own, and the few sums of the ranges are added up before. A null
    in ``by`` is a key of its own; a null ``value`` adds nothing.
    """
    ranged = stored(rows.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()), name)
    sums = ranged.groupBy(*by, "__range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    whole = W.partitionBy(*by)  # one row for each range
    before = whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(whole).alias("total"))
    same = F.col("__range") == F.col("__r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    inside = W.partitionBy(*by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    met = ranged.join(sums, same).withColumn("below", F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return met.drop("__range", "__r", "__before", *[f"__{b}" for b in by])

