"""MinHash near-duplicates with bottom-k sketches from one hash function.

1. Every document gives the hash set of its word shingles, a digest of that set and the k
   least hashes. Documents with one digest form a class; one of each class goes on.
2. Inverted lists over the retained values generate overlaps. Two sets at the threshold
   share at least ``least`` of k retained values (see ``least_shared``), so only the rarest
   k - least + 1 values of a sketch need lists (prefix filtering; values of one class alone
   count as rarest and have no list).
3. Short lists give pairs, which the union-sketch estimate filters and the exact Jaccard of
   the full sets verifies.
4. Long lists (over ``long_list`` classes) never emit their pairs. Lists that hold mostly
   the same classes are put together to clusters and cut into blocks of ``block`` classes
   within a band of set sizes. A task finds exact intersections by matrix products over full
   sets, and gives only links that join components. First each block meets ``pivots`` classes
   of its own and the neighbouring bands: a row for a class and ``pivots`` for a block. Then
   only classes outside their cluster's largest component meet the blocks of the cluster
   again, u * m / ``block`` rows for u such classes of m; the near copies of one text are in
   the largest component by then. These rows carry sketches; only classes with a possible
   partner in a block meet it with their full sets. Lists of unlike texts with one common shingle, where u is
   about m, stay quadratic by that factor.
5. Connected components over all links.

With k = 32 and least = 14 a pair at the threshold of 0.8 is missed with a probability of
about 4e-7, and less above it; sets of up to k shingles are treated exactly.

Defined results: null or empty texts and texts of white space have no shingles, are linked
with nothing and are their own component; null doc_ids take part and never are a
component's id unless all ids in it are null; ``kept`` compares null-safely; repeated rows
give repeated results; extra columns named like one of the operator's are refused; an empty table gives an empty result; a very long text gives its whole
set, a worker holds the texts of HELD rows at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.llm.base import one_thread, slices, stored, table
from granula.llm.components import components

K, LEAST, LONG_LIST, BLOCK, PIVOTS, CACHE = 32, 14, 40, 128, 16, 100_000
#: Rows whose texts and sets a Python worker holds at once, and parts of a long list in a join.
HELD, SALTS = 256, 16
#: Names that extra columns cannot have.
RESERVED = ("doc_id", "h", "n_shingles", "fp", "sketch", "component", "component_id", "kept", "copies", "text")
#: Classes that can each hold more than one part in this many of all rows.
MOST_LARGE = 1000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Hash sets of word shingles; the hashes of words are kept up to a bound."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def __call__(self, data: bytes | None) -> np.ndarray:
        """Sorted distinct 63-bit hashes of a UTF-8 text. bytes.lower() and bytes.split() know ASCII letters and white space only."""
        words = (data or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > CACHE:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = digest(w)
        hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
        return np.unique(out >> np.uint64(1))  # 63 bits: Spark's signed order is the order of the sketches


def set_digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketches(docs: DataFrame, width: int, k: int = K, extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, h, n_shingles, fp, sketch) and the extra columns of (doc_id, text): one pass, no shuffle; h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in slices(batches, HELD):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *batch.columns[2:],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.array([s[:k].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "h", *extra, "n_shingles", "fp", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"), *extra)
    kinds = dict(rows.dtypes)
    more = "".join(f", `{c}` {kinds[c]}" for c in extra)
    return rows.mapInArrow(run, f"doc_id long, h long{more}, n_shingles long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(fp, hashes) of (fp, digest, text), one row for each fp; rows whose text has another digest are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in slices(batches, HELD):
            found = [(f, s) for f, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if set_digest(s := shingles(t)) == d]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int64()), pa.array([s.astype(np.int64) for _, s in found], pa.list_(pa.int64()))], ["fp", "hashes"])

    rows = docs.select("fp", "digest", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "fp long, hashes array<long>").dropDuplicates(["fp"])


def least_shared(n, percent: int, k: int = K, least: int = LEAST):
    """Retained values that a set of n shingles shares at least with any set it is linked to.

    Sets of up to k shingles: the exact bound of their own size, less what a larger partner
    may fail to retain. Larger ones: ``least``, the binomial bound.
    """
    exact = F.ceil(n * percent / 100).cast("int")
    widest = math.floor(k * 100 / percent)  # a larger set has no partner of k or fewer
    return F.when(n <= k, F.greatest(F.lit(1), F.least(exact, F.lit(k - (widest - k))))).otherwise(F.lit(least))


def postings(classes: DataFrame, percent: int, k: int = K, least: int = LEAST) -> DataFrame:
    """(value, df, fp, n): the inverted lists that can hold a linked pair."""
    each = classes.select("fp", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = each.join(shared, "value").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    held = F.least(F.col("n"), F.lit(k)).cast("int")
    prefix = held - least_shared(F.col("n"), percent, k, least) + 1 - (held - F.size("vs"))
    return rows.where(prefix > 0).select("fp", "n", F.explode(F.slice("vs", F.lit(1), prefix)).alias("v")).select(F.col("v.value").alias("value"), F.col("v.df").alias("df"), "fp", "n")


def likely_pairs(pairs: DataFrame, classes: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(a, b, na, nb): the pairs whose estimate from the union sketch allows a link."""
    side = lambda s: classes.select(F.col("fp").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    return both.where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) * k >= F.size(union) * F.lit(least)).select("a", "b", "na", "nb")


def candidates(lists: DataFrame, percent: int, long_list: int) -> DataFrame:
    """Distinct pairs (a, b) of the short lists whose sizes allow a link."""
    short = lists.where(F.col("df") <= long_list)
    x, y = (short.select("value", F.col("fp").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return x.join(y, "value").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def _dealt_join(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row for each key; the rows of a long key are dealt to SALTS parts by their class."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return dealt.join(small.withColumn("__part", parts), [*on, "__part"], how).drop("__part")


def _merged_lists(long: DataFrame) -> DataFrame:
    """(cluster, fp, n): long lists, with a list put into a longer one that holds half its classes or more."""
    sized = long.groupBy("value").agg(F.count(F.lit(1)).alias("m"))
    x = _dealt_join(long, sized, ["value"]).select("fp", F.col("value").alias("v"), F.col("m").alias("vm"))
    own = x.groupBy("fp").agg(F.collect_list(F.struct(F.col("vm").alias("m"), F.col("v").alias("v"))).alias("vs"))  # k values at most
    pair = own.select(F.explode("vs").alias("x"), "vs").select("x", F.explode("vs").alias("y")).where(F.col("x") < F.col("y"))
    best = pair.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * 2 >= F.col("x.m"))
    up = best.groupBy(F.col("x.v").alias("v")).agg(F.max(F.struct("y", "c"))["y"]["v"].alias("up"))
    for _ in range(3):
        up = up.join(up.select(F.col("v").alias("u2"), F.col("up").alias("up2")), F.col("up") == F.col("u2"), "left").select("v", F.coalesce("up2", "up").alias("up"))
    top = _dealt_join(long, up.withColumnRenamed("v", "value"), ["value"], "left")
    return top.select(F.coalesce("up", "value").alias("cluster"), "fp", "n").distinct()


def _banded(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(cluster, fp, n, band, part, parts): each class in one block of its cluster and band of sizes; linked sets lie in one band or in neighbouring ones."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = members.withColumn("band", band)
    sized = rows.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    return _dealt_join(rows, sized, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))


def _to_blocks(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` (cluster, band, ...) once for each block (cluster, to_band, to_part) of ``sized`` (cluster, band, parts) in the own band and its neighbours."""
    near = rows.withColumn("to_band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    found = near.join(sized.select("cluster", F.col("band").alias("to_band"), F.col("parts").alias("__parts")), ["cluster", "to_band"])
    return found.withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def _with_pivots(blocks: DataFrame, pivots: int) -> DataFrame:
    """(cluster, to_band, to_part, fp, root): the classes of each block, and ``pivots`` of each cluster and band, sent to all blocks that they can be linked with.

    One row for a class and ``pivots`` for a block: linear in the classes.
    """
    order = W.partitionBy("cluster", "band").orderBy(F.xxhash64("fp"), "fp")
    few = blocks.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= pivots).drop("__at")
    sized = blocks.select("cluster", "band", "parts").distinct()
    own = blocks.select("cluster", F.col("band").alias("to_band"), F.col("part").alias("to_part"), "fp")
    return own.union(_to_blocks(few.select("cluster", "band", "fp"), sized).select("cluster", "to_band", "to_part", "fp")).distinct().withColumn("root", F.col("fp"))


def _rest_pairs(blocks: DataFrame, roots: DataFrame, block: int, name: str) -> DataFrame:
    """(cluster, band, part, to_band, to_part, fp, root): what can still join two components.

    In each cluster the classes outside its largest component are dealt to blocks of their
    own, and each of these meets every block of the cluster; classes of the largest component
    are never compared among themselves again.
    """
    rows = blocks.join(roots, F.col("fp") == F.col("node"), "left").select("cluster", "fp", "band", "part", F.coalesce("root", "fp").alias("root"))
    rows = stored(rows, f"{name}-members")
    most = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "root")).alias("most")).select("cluster", F.col("most.root").alias("main"))
    rest = _dealt_join(rows, most, ["cluster"]).where(F.col("root") != F.col("main")).drop("main", "part")
    sized = rest.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    rest = stored(_dealt_join(rest, sized, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")), f"{name}-rest")
    all_blocks = rows.groupBy("cluster", "band").agg((F.max("part") + 1).alias("parts"))
    here = _to_blocks(rest.select("cluster", "band", "part", "fp", "root"), all_blocks).select("cluster", "band", "part", "to_band", "to_part", "fp", "root")
    few = rest.select("cluster", "band", "parts").distinct()
    there = _to_blocks(rows.select("cluster", "band", "part", "fp", "root"), few)
    there = there.select("cluster", F.col("to_band").alias("band"), F.col("to_part").alias("part"), F.col("band").alias("to_band"), F.col("part").alias("to_part"), "fp", "root")
    return here.union(there).distinct()


def _forest(percent: int, chunk: int = 4096):
    """Links between components in one group of classes: exact intersections of all sets, reduced to what joins two roots."""

    def run(rows: pa.Table) -> pa.Table:
        one_thread()
        n, fps = len(rows), rows["fp"].to_pylist()
        sets = rows["hashes"].combine_chunks()
        size = sets.value_lengths().to_numpy()
        values, where = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        shared = np.bincount(where, minlength=len(values)) > 1
        column = np.cumsum(shared) - 1
        keep = shared[where]
        owner, column = owner[keep], column[where[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), np.float64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
            lo, hi = np.searchsorted(column, (at, at + chunk))
            m = np.zeros((n, chunk), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
        linked = both * 100 >= percent * (size[:, None] + size[None, :] - both)
        _, first = np.unique(rows["root"].to_numpy(), return_inverse=True)
        linked &= first[:, None] != first[None, :]
        root = list(range(n))

        def find(a):
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        out = []
        a, b = np.nonzero(np.triu(linked, 1))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := find(int(first[x]))) != (q := find(int(first[y]))):
                root[q] = p
                out.append((fps[x], fps[y]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _may_link(rows: DataFrame, marks: DataFrame, group: list[str], percent: int, k: int, least: int, once: bool = False) -> DataFrame:
    """The ``rows`` (group, fp, root) with another root in their group that their sketches and sizes allow a link with.

    ``marks``: (fp, size, sketch, clusters). With ``once`` a pair counts only in the least of the
    clusters that both are in, for groups that compare all of a cluster. Sketches are a small part of full sets, which only the rows
    that are left meet. No pair is lost that likely_pairs() would keep: what two sketches
    share is never less than what they share of their union's sketch.
    """

    def run(rows: pa.Table) -> pa.Table:
        one_thread()
        n, sketch = len(rows), rows["sketch"].combine_chunks()
        held = sketch.value_lengths().to_numpy()
        _, column = np.unique(sketch.flatten().to_numpy(), return_inverse=True)
        has = np.zeros((n, int(column.max()) + 1), np.float32)
        has[np.repeat(np.arange(n), held), column] = 1
        both = has @ has.T
        whole = np.minimum(k, held[:, None] + held[None, :] - both)
        size = rows["size"].to_numpy().astype(np.int64)
        fits = np.minimum(size[:, None], size[None, :]) * 100 >= np.maximum(size[:, None], size[None, :]) * percent
        _, first = np.unique(rows["root"].to_numpy(), return_inverse=True)
        may = (both * k >= whole * least) & fits & (first[:, None] != first[None, :])
        if once:
            here, clusters = rows["cluster"][0].as_py(), [set(c) for c in rows["clusters"].to_pylist()]
            for a, b in np.argwhere(np.triu(may)).tolist():
                may[a, b] = may[b, a] = min(clusters[a] & clusters[b]) == here
        return rows.select([*group, "fp", "root"]).filter(pa.array(may.any(axis=1)))

    kinds = dict(rows.dtypes)
    return rows.join(marks, "fp").groupBy(*group).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*group, "fp", "root"]))


def component_roots(docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int, least: int, long_list: int, block: int, pivots: int, name: str) -> DataFrame:
    """(node, root) of all linked classes.

    Short lists give their links one by one. Long ones give, first, what joins the classes of
    a block and some pivots; second, what joins the components that are left.
    """
    lists = stored(postings(classes, percent, k, least), f"{name}-lists")
    likely = stored(likely_pairs(candidates(lists, percent, long_list), classes, k, least), f"{name}-pairs")
    blocks = stored(_banded(_merged_lists(lists.where(F.col("df") > long_list)), percent, block), f"{name}-blocks")
    of = blocks.groupBy("fp").agg(F.collect_set("cluster").alias("clusters"))  # k values at most
    marks = stored(classes.select("fp", F.col("n").alias("size"), "sketch").join(of, "fp"), f"{name}-marks")
    near = stored(_may_link(_with_pivots(blocks, pivots), marks, ["cluster", "to_band", "to_part"], percent, k, least), f"{name}-near")

    def sets_of(needed: DataFrame) -> DataFrame:
        """Full sets of the classes ``needed`` (fp)."""
        needed = needed.join(classes.select("fp", "digest", F.col("doc_id").alias("__rep"), F.col("h").alias("__h")), "fp")
        # by id and text, so that many rows with one id (or none) do not meet the representatives of others
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        texts = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("__rep")) & (F.col("h") == F.col("__h")))
        return stored(full_sets(texts, width), f"{name}-sets")

    sets = sets_of(likely.select(F.col("a").alias("fp")).union(likely.select("b")).union(near.select("fp")).distinct())
    side = lambda s: sets.select(F.col("fp").alias(s), F.col("hashes").alias(f"h{s}"))
    both = F.size(F.array_intersect("ha", "hb"))
    checked = likely.join(side("a"), "a").join(side("b"), "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    joins = near.join(sets, "fp").groupBy("cluster", "to_band", "to_part").applyInArrow(_forest(percent), "a long, b long")
    found = stored(checked.union(joins), f"{name}-links")
    roots = components(found, name)
    group = ["cluster", "band", "part", "to_band", "to_part"]
    rest = stored(_may_link(_rest_pairs(blocks, roots, block, name), marks, group, percent, k, least, once=True), f"{name}-left")
    if rest.isEmpty():
        return roots
    sets = sets.union(sets_of(rest.select("fp").distinct().join(sets.select("fp"), "fp", "left_anti")))
    more = rest.join(sets, "fp").groupBy(*group).applyInArrow(_forest(percent), "a long, b long")
    # a component is one node now, named by its root
    joined = stored(more, f"{name}-more")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(joined), name)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, least: int = LEAST, long_list: int = LONG_LIST, block: int = BLOCK, name: str = "near", extra: Sequence[str] = (), pivots: int = PIVOTS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Linked: 100 * intersection >= percent * union of the shingle sets. With ``extra`` columns
    these come too, and ``component``: one value for all rows of a component whatever their
    ids, null for rows without shingles.
    """
    if taken := [c for c in extra if c.lower() in RESERVED]:
        raise ValueError(f"extra columns cannot be called {', '.join(taken)}")
    rows = stored(sketches(docs, width, k, extra), f"{name}-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(first.alias("first"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    # a class is a number from here on, fixed as it is written
    classes = classes.select(F.monotonically_increasing_id().alias("fp"), F.col("fp").alias("digest"), "first.doc_id", "first.h", F.col("n").cast("int").alias("n"), "sketch", "copies")
    classes = stored(classes, f"{name}-classes")
    roots = component_roots(docs, classes, width, percent, k, least, long_list, block, pivots, name)
    of = classes.select("fp", "digest", "doc_id", "copies").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "digest", "doc_id", "copies", "root")
    low = of.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("low"))
    of = of.join(low, "root", "left").select(F.col("digest").alias("fp"), "copies", F.coalesce("root", "fp").alias("component"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    more = [*extra, "component"] if extra else []
    # classes with more than a thousandth of all rows, of which there are fewer than a thousand, meet their rows by broadcast; the others by a shuffle
    of = stored(of, f"{name}-of")
    large = F.col("copies") * MOST_LARGE > rows.count()
    named = rows.where(F.col("fp").isNotNull()).select("doc_id", "n_shingles", "fp", *extra)
    found = of.where(large).select("fp", "component", "component_id")
    hot = named.join(F.broadcast(found), "fp")
    cold = named.join(F.broadcast(found.select("fp")), "fp", "left_anti").join(of.where(~large), "fp")
    some = hot.select("doc_id", "n_shingles", "component_id", *more).union(cold.select("doc_id", "n_shingles", "component_id", *more))
    none = rows.where(F.col("fp").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *extra, *[F.lit(None).cast("long").alias("component")] * bool(extra))
    return some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 2-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, name="op3")
