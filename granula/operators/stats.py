"""Rank tests, effect sizes and histograms of pooled values.

Values are (group, value) rows with one value per object; the tests run per pair of groups
through running counts over ranges of the pooled values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.prefix import running_sums
from granula.functions.storage import spread, stored

#: Samples of at most this size together are tested exactly.
EXACT = 20
#: Pairs of values that are listed for each distinct value, at most, and pivots between two bounds in a round of selection.
LISTED = 32
PIVOTS, BINS = 15, 256


def object_medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """One median per object: what enters a test."""
    return rows.groupBy(*group).agg(F.median(value).alias("value"))


def pairs(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All unordered pairs of the group names, n (n - 1) / 2 rows; with ``by`` within each of its values. Names are few."""
    a, b = groups.select(*by, F.col("group").alias("group_a")), groups.select(*by, F.col("group").alias("group_b"))
    if by:
        return a.join(b, [*by]).where(F.col("group_a") < F.col("group_b"))
    return a.join(F.broadcast(b), F.col("group_a") < F.col("group_b"))


def value_counts(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, group_a, group_b, value, na, nb): how often each value occurs on either side of each pair."""
    counts = values.where("value is not null").groupBy(*by, "group", "value").agg(F.count(F.lit(1)).alias("n"))
    names = pairs(values.select(*by, "group").distinct(), by)
    to = lambda g: counts.select(*by, F.col("group").alias(g), "value", "n")
    side = lambda g, na, nb: names.join(to(g), [*by, g]).select(*by, "group_a", "group_b", "value", na.alias("na"), nb.alias("nb"))
    none = F.lit(0).cast("long")
    both = side("group_a", F.col("n"), none).union(side("group_b", none, F.col("n")))
    return both.groupBy(*by, "group_a", "group_b", "value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def _summed(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    met = running_sums(counts, [*by, "group_a", "group_b"], "value", "nb", name)
    tied = (F.col("na") + F.col("nb")).cast("double")
    return met.groupBy(*by, "group_a", "group_b").agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"),
        F.sum(F.col("na") * (F.col("below") + F.col("nb") / 2)).alias("u"), F.sum(tied * (tied * tied - 1)).alias("ties"),
    )


def rank_sums(values: DataFrame, name: str = "ranks", by: Sequence[str] = ()) -> DataFrame:
    """U of group_a, sizes and the tie term of each pair, from running counts over ranges of values."""
    return _summed(value_counts(values, by), by, name)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of k logarithms; null for k > n."""
    terms = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k <= n, F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.ln((n - k + i).cast("double") / i)))


def p_floor(sums: DataFrame) -> DataFrame:
    """The least two-sided p a pair can reach, 2 / C(n_a + n_b, n_a), and whether no star is in its reach."""
    least = F.least(F.lit(1.0), 2 * F.exp(-log_binomial(F.col("n_a") + F.col("n_b"), F.col("n_a"))))
    return sums.withColumn("p_min", least).withColumn("floor", F.col("p_min") >= 0.05)


def doubled_ranks(ties: Column) -> Column:
    """Twice the ranks of pooled values, of which ``ties`` counts those that are alike, by rising value; all alike share their mean rank."""
    before = lambda j: F.aggregate(F.slice(ties, F.lit(1), j), F.lit(0), lambda a, t: a + t)
    return F.flatten(F.transform(ties, lambda t, j: F.array_repeat(2 * before(j) + t + 1, t)))


def exact_ways(ranks: Column, chosen: Column, width: Column) -> Column:
    """How many choices of ``chosen`` of the doubled ``ranks`` give each sum 0, 1, 2, ... below ``width``.

    The values are added one after the other to a table of counts by number and sum.
    """
    start = F.transform(F.sequence(F.lit(0), (chosen + 1) * width - 1), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    more = lambda ways, r, i: F.when(i % width >= r, F.coalesce(F.get(ways, i - width - r), F.lit(0.0))).otherwise(F.lit(0.0))
    full = F.aggregate(ranks, start, lambda ways, r: F.transform(ways, lambda w, i: w + more(ways, r, i)))
    return F.slice(full, chosen * width + 1, width)


def exact_p(ways: Column, n_a: Column, n: Column, doubled: Column) -> Column:
    """Two-sided p: the share of all choices whose doubled rank sum is as far from the middle as ``doubled`` or farther."""
    centre = n_a * (n + 1)
    far = F.transform(ways, lambda w, s: F.when(F.abs(s - centre) >= F.abs(doubled - centre) - 1e-9, w).otherwise(F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, w: a + w)
    return F.least(F.lit(1.0), total(far) / total(ways))


def mann_whitney(values: DataFrame, by: Sequence[str] = (), exact: int = EXACT, name: str = "ranks") -> DataFrame:
    """(by, group_a, group_b, n_a, n_b, u, p, method): two-sided p of each pair.

    Up to ``exact`` values together the p is exact, over all splits with mean ranks where values
    tie (method "exact" without ties, else "permutation"); the counts of rank sums are worked
    out once for each size and pattern of ties, whatever the number of pairs that share it.
    Larger ones take the tie-corrected normal with continuity ("asymptotic"). Null for groups
    under two or values all alike.
    """
    keys = [*by, "group_a", "group_b"]
    counts = stored(value_counts(values, by), f"{name}-counts")
    sums = stored(_summed(counts, by, name), f"{name}-sums")
    n = F.col("n_a") + F.col("n_b")
    testable = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    few = counts.join(sums.where(testable & (n <= exact)).select(*keys), keys, "left_semi").groupBy(*keys)
    alike = F.transform(F.sort_array(F.collect_list(F.struct("value", (F.col("na") + F.col("nb")).cast("int").alias("n")))), lambda x: x["n"])
    few = stored(few.agg(alike.alias("tied")).where(F.size("tied") > 1), f"{name}-tied")  # ``exact`` values at most
    few = few.join(sums, keys)
    tables = few.select("tied", F.col("n_a").cast("int").alias("k"), (n * (n + 1) + 1).cast("int").alias("width")).distinct()
    tables = stored(spread(tables.withColumn("ranks", doubled_ranks(F.col("tied"))), "tied", "k"), f"{name}-patterns")
    tables = stored(tables.select("tied", "k", exact_ways(F.col("ranks"), F.col("k"), F.col("width")).alias("ways")), f"{name}-ways")
    doubled = 2 * F.col("u") + F.col("n_a") * (F.col("n_a") + 1)
    found = few.join(tables, (few["tied"] == tables["tied"]) & (F.col("n_a") == F.col("k"))).select(*keys, exact_p(F.col("ways"), F.col("n_a"), n, doubled).alias("p_exact"))

    @F.pandas_udf("double")
    def upper_tail(z):
        return 0.5 * z.map(lambda x: math.erfc(x / math.sqrt(2)), na_action="ignore").astype("float64")

    deviation = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2) - 0.5), deviation)
    normal = F.when(testable & (deviation > 0), F.least(F.lit(1.0), 2 * upper_tail(z)))
    p = F.when(n <= exact, F.col("p_exact")).otherwise(normal)
    method = F.when(p.isNull(), None).when(n > exact, "asymptotic").when(F.col("ties") > 0, "permutation").otherwise("exact")
    return sums.join(found, keys, "left").select(*keys, "n_a", "n_b", "u", p.alias("p"), method.alias("method"))


def effect(values: DataFrame) -> DataFrame:
    """P(a > b) - P(a < b) of each pair, from U."""
    return rank_sums(values).select("group_a", "group_b", F.try_divide(2 * F.col("u") - F.col("n_a") * F.col("n_b"), F.col("n_a") * F.col("n_b")).alias("delta"))


def _counted(asked: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, k, p, n, m): for each of ``asked`` (keys, k, p) the pairs and the distinct pairs (a, b) with b >= a - p."""
    none = F.lit(0).cast("long")
    left = a.join(asked, keys).select(*keys, "k", "p", (F.col("x") - F.col("p")).alias("v"), F.col("n").alias("na"), (none + 1).alias("ma"), none.alias("nb"), none.alias("mb"))
    right = b.join(asked, keys).select(*keys, "k", "p", F.col("y").alias("v"), none.alias("na"), none.alias("ma"), F.col("n").alias("nb"), (none + 1).alias("mb"))
    at = [*keys, "k", "p"]
    met = left.union(right).groupBy(*at, "v").agg(*[F.sum(c).alias(c) for c in ("na", "ma", "nb", "mb")])
    # one running sum for both: the counts of values and of distinct values of b, side by side
    met = running_sums(met.withColumn("both", F.col("nb").cast("decimal(20,0)") * F.lit(10**16).cast("decimal(17,0)") + F.col("mb")), at, "v", "both", name)
    above = (F.col("total") - F.col("below")).cast("decimal(38,0)")
    nb = F.floor(above / F.lit(10**16).cast("decimal(17,0)")).cast("long")
    mb = (above % F.lit(10**16).cast("decimal(17,0)")).cast("long")
    return met.groupBy(*at).agg(F.sum(F.col("na") * nb).alias("n"), F.sum(F.col("ma") * mb).alias("m"))


def _first_pivots(state: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, p): two pivots for each wanted place, from how many values fall in each of BINS bins.

    Pairs of bins give the differences to one bin more or less, so their running counts enclose the place.
    """
    ends = counts.groupBy(*keys).agg(F.min("value").alias("from"), ((F.max("value") - F.min("value")) / BINS).alias("width")).where("width > 0")
    at = F.least(F.lit(BINS - 1), F.floor((F.col("value") - F.col("from")) / F.col("width")))
    binned = counts.join(ends, keys).groupBy(*keys, "width", at.alias("bin")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    a = binned.where("na > 0").select(*keys, "width", F.col("bin").alias("i"), "na")
    b = binned.where("nb > 0").select(*keys, F.col("bin").alias("j"), "nb")
    apart = a.join(b, keys).groupBy(*keys, "width", (F.col("i") - F.col("j")).alias("d")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))  # BINS * BINS pairs of bins
    upto = W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)  # 2 * BINS - 1 rows
    cum = apart.withColumn("cum", F.sum("n").over(upto)).join(state.select(*keys, "k"), keys)
    room = F.col("width") * 1e-6
    low = F.max(F.when(F.col("cum") <= F.col("k"), F.col("d") * F.col("width") - room))
    high = F.min(F.when(F.col("cum") > F.col("k"), (F.col("d") + 1) * F.col("width") + room))
    found = cum.groupBy(*keys, "k").agg(F.array_compact(F.array(low, high)).alias("ps"))
    return found.select(*keys, "k", F.explode("ps").alias("p"))


def shift(values: DataFrame, by: Sequence[str] = (), pivots: int = PIVOTS, name: str = "shift") -> DataFrame:
    """(by, group_a, group_b, shift): the median of all differences a - b of each pair.

    Selection by rounds: between two bounds that enclose the wanted difference lie pivots, first
    from counts by bins of values and then equally spaced, and running counts over ranges of the
    pooled values tell how many differences each has below. Bounds close in until they enclose no more distinct pairs of values than a few times
    the distinct values; only these are listed, by a join of value ranges. No task holds a
    group, and not all differences are ever listed.
    """
    keys = [*by, "group_a", "group_b"]
    counts = stored(value_counts(values.withColumn("value", F.col("value").cast("double")), by), f"{name}-counts")
    a = counts.where("na > 0").select(*keys, F.col("value").alias("x"), F.col("na").alias("n"))
    b = counts.where("nb > 0").select(*keys, F.col("value").alias("y"), F.col("nb").alias("n"))
    size = counts.groupBy(*keys).agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum((F.col("na") > 0).cast("long")).alias("ma"), F.sum((F.col("nb") > 0).cast("long")).alias("mb"),
        (F.min(F.when(F.col("na") > 0, F.col("value"))) - F.max(F.when(F.col("nb") > 0, F.col("value")))).alias("low"),
        (F.max(F.when(F.col("na") > 0, F.col("value"))) - F.min(F.when(F.col("nb") > 0, F.col("value")))).alias("high"),
    )
    n = F.col("na") * F.col("nb")
    middle = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))  # places from 0
    room = (F.abs("low") + F.abs("high") + 1) * 1e-9
    state = size.where((F.col("na") > 0) & (F.col("nb") > 0)).select(
        *keys, F.explode(middle).alias("k"), (F.col("low") - room).alias("low"), (F.col("high") + room).alias("high"), F.lit(0).cast("long").alias("n_low"), F.lit(0).cast("long").alias("m_low"),
        (F.col("ma") * F.col("mb")).alias("m_high"), (LISTED * (F.col("ma") + F.col("mb")) + 1000).alias("few"),
    )
    state = stored(state, f"{name}-state")
    step = (F.col("high") - F.col("low")) / (pivots + 1)
    is_open = (F.col("m_high") - F.col("m_low") > F.col("few")) & (F.col("low") + step > F.col("low")) & (F.col("high") - step < F.col("high"))
    first = True
    while not state.where(is_open).isEmpty():
        open_ = state.where(is_open)
        asked = _first_pivots(open_, counts, keys) if first else open_.select(*keys, "k", F.explode(F.transform(F.sequence(F.lit(1), F.lit(pivots)), lambda j: F.col("low") + step * j)).alias("p"))
        first = False
        met = _counted(stored(asked, f"{name}-pivots"), a, b, keys, name)
        under = F.max(F.when(F.col("n") <= F.col("k"), F.struct("p", "n", "m"))).alias("under")
        over = F.min(F.when(F.col("n") > F.col("k"), F.struct("p", "m"))).alias("over")
        met = met.groupBy(*keys, "k").agg(under, over)
        moved = state.join(met, [*keys, "k"], "left").select(
            *keys, "k", F.coalesce("under.p", "low").alias("low"), F.coalesce("over.p", "high").alias("high"), F.coalesce("under.n", "n_low").alias("n_low"), F.coalesce("under.m", "m_low").alias("m_low"),
            F.coalesce("over.m", "m_high").alias("m_high"), "few",
        )
        state = stored(moved, f"{name}-state")
    # the pairs between the bounds: values b from a - high up to, but without, a - low; a wide cell of values holds those of one a or its neighbour
    wide = F.col("high") - F.col("low")
    held = state.select(*keys, "k", "low", "high", "n_low", wide.alias("wide"))
    cell = lambda v: F.floor(v / F.col("wide")).cast("long")
    x = a.withColumnRenamed("n", "na").join(held, keys)
    x = x.withColumn("from", F.col("x") - F.col("high")).withColumn("to", F.col("x") - F.col("low"))
    x = x.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    y = b.withColumnRenamed("n", "nb").join(held.select(*keys, "k", "wide"), keys).withColumn("cell", cell(F.col("y")))
    near = x.join(y.select(*keys, "k", "cell", "y", "nb"), [*keys, "k", "cell"]).where((F.col("y") >= F.col("from")) & (F.col("y") < F.col("to")))
    listed = near.groupBy(*keys, "k", "n_low", (F.col("x") - F.col("y")).alias("d")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    placed = running_sums(listed, [*keys, "k", "n_low"], "d", "n", f"{name}-listed")
    at = F.col("k") - F.col("n_low")
    found = placed.where((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).groupBy(*keys).agg(F.avg("d").alias("shift"))
    return size.select(*keys).join(found, keys, "left")


def ecdf(rows: DataFrame, by: list[str], value: str, name: str = "ecdf") -> DataFrame:
    """Percent of values at or below each, one row per value; summed by ranges of values, so a group may be large."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, by, value, "n", name).select(*by, value, (100 * (F.col("below") + F.col("n")) / F.col("total")).alias("percent"))


def share_curve(rows: DataFrame, by: list[str], value: str, vertices: int = 100) -> DataFrame:
    """The curve that is drawn: from 0 percent at the least value, then the last value of each of ``vertices`` equal steps of percent, up to 100."""
    curve = ecdf(rows, by, value, "share-curve")
    step = F.ceil(F.round(F.col("percent") * vertices / 100, 9))
    ends = curve.groupBy(*by, step.alias("step")).agg(F.max(value).alias(value), F.max("percent").alias("percent"))
    start = curve.groupBy(*by).agg(F.lit(0).cast("long").alias("step"), F.min(value).alias(value), F.lit(0.0).alias("percent"))
    return start.unionByName(ends).select(*by, "step", value, "percent")


def shared_histogram(rows: DataFrame, facet: str, value: str, bins: int) -> DataFrame:
    """Percent by bin of each facet over one range; nothing where all values are alike."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("hi > lo")
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = rows.join(F.broadcast(ends)).groupBy(facet, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(facet, "bin", (100 * F.col("n") / F.sum("n").over(W.partitionBy(facet))).alias("percent"))


def median_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Interpolated median of (bin, n, lo, width) rows; groups without counts have no row."""
    order = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sums = counts.where("n > 0").withColumn("cum", F.sum("n").over(order)).withColumn("half", F.sum("n").over(W.partitionBy(*by)) / 2)
    first = sums.where("cum >= half").withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("bin"))).where("k = 1")
    return first.select(*by, (F.col("lo") + F.col("width") * (F.col("bin") + (F.col("half") - (F.col("cum") - F.col("n"))) / F.col("n"))).alias("median"))


def rebinned(counts: DataFrame, by: list[str], lo: float, width: float, bins: int) -> DataFrame:
    """Source bins (bin, n, lo, width) added to the shared bin that holds their centre, as densities."""
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((centre - lo) / width))).cast("int")
    moved = counts.groupBy(*by, at.alias("to_bin")).agg(F.sum("n").alias("n"))
    return moved.select(*by, "to_bin", (F.col("n") / F.sum("n").over(W.partitionBy(*by)) / width).alias("density"))


def bin_count(asked: Column, span: Column, source_width: Column) -> Column:
    """Bins of a drawn histogram: as asked, but no finer than its sources and four at least."""
    return F.greatest(F.lit(4), F.least(asked, F.round(F.try_divide(span, source_width)))).cast("int")


def chance_curve(counts: DataFrame, by: list[str], asked: int) -> DataFrame:
    """(by, to_bin, low, width, density): pooled source bins on a shared span, the density of each group sums to 1 over the width.

    The number of bins follows ``bin_count`` for the span of the group's sources.
    """
    ends = counts.groupBy(*by).agg(F.min(F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.max(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.min("width").alias("fine"))
    span = F.col("high") - F.col("low")
    ends = ends.withColumn("bins", bin_count(F.lit(asked), span, F.col("fine"))).withColumn("step", span / F.col("bins")).drop("fine", "high")
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    at = F.least(F.col("bins") - 1, F.floor((centre - F.col("low")) / F.col("step"))).cast("int")
    moved = counts.join(ends, by).groupBy(*by, "low", "step", at.alias("to_bin")).agg(F.sum("n").alias("n"))
    return moved.select(*by, "to_bin", "low", F.col("step").alias("width"), (F.col("n") / F.sum("n").over(W.partitionBy(*by)) / F.col("step")).alias("density"))


def chance_values(rows: DataFrame, by: list[str], unit: str, value: str, counts: DataFrame) -> DataFrame:
    """(by, chance_um): the plain median where one object gave all values of a group, else the median of its pooled counts (by, bin, n, lo, width)."""
    own = rows.groupBy(*by).agg(F.count_distinct(unit).alias("n_objects"), F.median(value).alias("own"))
    return own.join(median_of_counts(counts, by), by, "left").select(*by, "n_objects", F.when(F.col("n_objects") > 1, F.col("median")).otherwise(F.col("own")).alias("chance_um"))


def corrected_chance(pooled: Column, gap: Column) -> Column:
    """A pooled median less the gap that an instance's own extent makes, 0 at least; without a gap as it is."""
    return F.greatest(F.lit(0.0), pooled - F.coalesce(gap, F.lit(0.0)))


def extent_gap(instances: DataFrame, by: list[str], minimum: str, mean: str) -> DataFrame:
    """(by, extent_gap_um): median of mean less least distance, what its own extent brings an instance nearer to a target."""
    return instances.where(F.col(minimum).isNotNull() & F.col(mean).isNotNull()).groupBy(*by).agg(F.median(F.col(mean) - F.col(minimum)).alias("extent_gap_um"))


def significance_label(p: Column) -> Column:
    """Stars and the p value, or why there is none."""
    from granula.functions.scalar import stars

    shown = F.when(p < 1e-4, F.lit("p < 0.0001")).otherwise(F.concat(F.lit("p = "), F.format_string("%.4f", p)))
    return F.when(p.isNull(), "untested").otherwise(F.concat_ws(" \u00b7 ", stars(p), shown))


def plan(values: DataFrame) -> DataFrame:
    """(group_a, group_b, n_a, n_b, reason): all pairs of groups, with the reason where a pair cannot be tested, the size first; none if no group can."""
    sizes = values.where("value is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    testable = sizes.where("n >= 2").agg(F.count(F.lit(1)).alias("testable")).where("testable > 0")
    a, b = (sizes.select(F.col("group").alias(f"group_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    found = a.join(b, F.col("group_a") < F.col("group_b")).join(F.broadcast(testable))
    reason = F.when((F.col("n_a") < 2) & (F.col("n_b") < 2), "1 object in both groups").when(F.col("n_a") < 2, F.concat(F.lit("1 object in "), "group_a")).when(F.col("n_b") < 2, F.concat(F.lit("1 object in "), "group_b"))
    return found.select("group_a", "group_b", "n_a", "n_b", reason.alias("reason"))


def untested_line(planned: DataFrame) -> DataFrame:
    """(line, rungs): one line for all pairs of ``planned`` (as of plan()) without a test, naming each group that is too small once, and the rungs over the groups: one for each tested pair and one for the line. No line if all are tested."""
    small = planned.where("reason is not null").select(F.explode(F.array(F.struct(F.col("group_a").alias("g"), F.col("n_a").alias("n")), F.struct(F.col("group_b").alias("g"), F.col("n_b").alias("n")))).alias("x"))
    names = small.select("x.*").where("n < 2").distinct().agg(F.array_sort(F.collect_list(F.format_string("%s (%d object)", "g", "n"))).alias("names"))  # groups are few
    line = F.when(F.size("names") > 0, F.concat(F.lit("not tested: "), F.array_join("names", ", ")))
    tested = planned.agg(F.count_if(F.col("reason").isNull()).alias("tested"), F.count(F.lit(1)).alias("all"))
    return names.join(F.broadcast(tested)).select(line.alias("line"), (F.col("tested") + (F.col("all") > F.col("tested")).cast("long")).alias("rungs"))


def rungs(tested: DataFrame) -> DataFrame:
    """(group_a, group_b, rung): heights of the brackets over a row of groups, so that brackets of one height do not overlap: by span, then by place.

    Groups are few: the places and the pairs fit one window.
    """
    names = tested.select(F.col("group_a").alias("g")).union(tested.select("group_b")).distinct()
    places = names.withColumn("place", F.row_number().over(W.orderBy("g")))
    at = lambda s: places.select(F.col("g").alias(f"group_{s}"), F.col("place").alias(f"p{s}"))
    return tested.join(F.broadcast(at("a")), "group_a").join(F.broadcast(at("b")), "group_b").select("group_a", "group_b", F.row_number().over(W.orderBy(F.col("pb") - F.col("pa"), "pa")).alias("rung"))
