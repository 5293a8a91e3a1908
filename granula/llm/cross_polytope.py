"""Approximate nearest neighbours by inner product with cross-polytope hashing.

1. Equal vectors form a class; as ties go to smaller ids, the k + 1 least ids of a class are
   all that a result can show of it. Classes and the distinct vectors of queries go on.
2. A hash is a pseudo-rotation (random signs and a fast Hadamard transform, three times) and
   the nearest signed axis. Unit vectors are hashed: a vector of norm r gets one more
   component, so that it lies on the sphere of the largest norm in its band (a factor of
   two), which keeps the order of inner products; a query has 0 there and probes every band.
3. Each table (TABLES of them, each of ``hashes`` hashes) holds every class. A query probes
   the ``probes`` best axes of a table. Their number is fitted: SAMPLE queries, those of least
   hash, meet all classes by brute force, and as many probes are taken as find RECALL of
   their k nearest in some table. The measure covers all rows, so it holds at every size.
4. Neighbouring buckets form cells of about CELL classes. A cell beyond that is dealt in parts
   of CELL classes by CELL queries, so a task holds two blocks however the vectors cluster.
   In it, matrix products find what can be among the k + 1 nearest, and inner products
   summed in order of the components, in double precision, rank that exactly.
5. The short lists of a query's cells are merged by query; rows of one query vector share them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without vec_id; of rows with one vec_id the least vector counts, so
repeated rows count once; shorter vectors end in zeros; equal scores rank by vec_id; with
fewer than k candidates found, a query has fewer rows; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.llm.base import one_thread, received, send, slices, stored, table

K, EVERY, TABLES, SEED, CELL = 20, 20, 4, 11, 4096
#: Queries that meet all rows to fit the number of probes, and the share of their neighbours to be found.
SAMPLE, RECALL = 200, 0.95
#: Distinct vectors from which a table takes two hashes.
TWO_HASHES = 2**20
HELD = 2048


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of ``column`` as rows of doubles, padded with zeros."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == sizes[0]).all():
        out[:, : sizes[0]] = flat.reshape(len(sizes), sizes[0])
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Hasher:
    """Signed axes of vectors of up to ``width`` components in ``tables`` tables."""

    def __init__(self, width: int, tables: int, hashes: int, seed: int):
        self.width, self.tables, self.hashes = width, tables, hashes
        self.size = 1 << width.bit_length()  # room for one more component
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, hashes, 3, self.size))
        self.axes = 2 * self.size
        self.buckets = self.axes**hashes

    def unit(self, x: np.ndarray, norm: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Points on the sphere: queries without ``most``, classes lifted to the largest norm of their band with it."""
        out = np.zeros((len(x), self.size), np.float32)
        if most is None:
            peak = np.abs(x).max(axis=1, keepdims=True, initial=0)
            x = x / peak
            out[:, : self.width] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, : self.width] = x / most[:, None]
            out[:, self.width] = np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))
        return out

    def values(self, unit: np.ndarray, at: int, k: int) -> np.ndarray:
        """The coordinates of ``unit`` after a pseudo-rotation, and their negatives."""
        for signs in self.signs[at, k]:
            unit, h = unit * signs, 1
            while h < self.size:
                pairs = unit.reshape(len(unit), -1, 2, h)
                unit = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(unit), self.size)
                h *= 2
        return np.concatenate([unit, -unit], axis=1) / np.float32(self.size**1.5)

    def buckets_of(self, unit: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(unit), np.int64)
        for k in range(self.hashes):
            out = out * self.axes + self.values(unit, at, k).argmax(axis=1)
        return out

    def probed(self, unit: np.ndarray, at: int, probes: int) -> np.ndarray:
        """The ``probes`` best buckets of each point, best first; a bucket is as good as the sum of its coordinates."""
        best, code = self.values(unit, at, 0), np.broadcast_to(np.arange(self.axes), (len(unit), self.axes))
        for k in range(1, self.hashes):
            order = np.argsort(-best, axis=1, kind="stable")[:, :probes]
            more = self.values(unit, at, k)
            then = np.argsort(-more, axis=1, kind="stable")[:, :probes]
            best, code = np.take_along_axis(best, order, 1), np.take_along_axis(code, order, 1)
            best = (best[:, :, None] + np.take_along_axis(more, then, 1)[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * self.axes + then[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(-best, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(code, order, 1)

    def places(self, query: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """For one query point and many classes: the least place, over the tables, of a class's bucket in the query's order, after all that are as good."""
        out = np.full(len(unit), self.buckets)
        for at in range(self.tables):
            own = [self.values(query[None], at, k)[0] for k in range(self.hashes)]
            code, score = self.buckets_of(unit, at), np.zeros(len(unit), np.float32)
            for v in reversed(own):
                score, code = score + v[code % self.axes], code // self.axes
            if self.hashes == 1:
                better = [(own[0] >= s).sum() - 1 for s in score]
            else:
                ordered = np.sort(own[1])
                better = [(self.axes - np.searchsorted(ordered, s - own[0] - np.float32(1e-6))).sum() - 1 for s in score]
            out = np.minimum(out, better)
        return out


def usable(df: DataFrame, column: str) -> DataFrame:
    """(vec_id, v, h): one row for each id with a vector of finite components, not all zero."""
    inf = F.lit(float("inf"))
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(column, lambda x: x != 0)
    rows = df.where(F.col("vec_id").isNotNull() & fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(column).alias("v"))
    return rows.withColumn("h", F.xxhash64("v"))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(key, v, ids, norm, band): one row for each distinct vector, with its ``keep`` least ids; key is the first."""
    order = W.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= keep)  # cut before the shuffle, too
    each = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    v = F.transform("v", lambda x: x.cast("double"))
    peak = F.array_max(F.transform(v, F.abs))
    norm = peak * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))
    each = each.withColumn("norm", norm).withColumn("band", F.floor(F.log2("norm") + 0.5).cast("int"))
    return each.select(F.element_at("ids", 1).alias("key"), "v", "ids", "norm", "band")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the components: equal vectors give equal sums wherever they stand."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def nearest(q: np.ndarray, x: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): of ``pairs`` of blocks (queries, rows), each query's k best rows by score and then ``first``."""
    least, met = np.full(len(q), -np.inf), []
    qn = np.linalg.norm(q, axis=1)
    slack = 1e-11 * qn * (np.linalg.norm(x, axis=1).max(initial=0) + 1e-300)  # over the rounding of a matrix product
    for a, b in pairs:
        s = q[a] @ x[b].T
        if len(b) >= k:
            least[a] = np.maximum(least[a], np.partition(s, len(b) - k, axis=1)[:, len(b) - k])
        i, j = np.nonzero(s >= (least[a] - slack[a])[:, None])
        met.append((a[i], b[j], s[i, j]))
    a, b, s = (np.concatenate([m[c] for m in met]) if met else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    start = np.searchsorted(a, np.arange(len(q)))
    last = s[np.minimum(start + k - 1, len(s) - 1)] if len(s) else s
    end = np.searchsorted(a, np.arange(len(q)), side="right")
    bound = np.where(end - start >= k, last, -np.inf) if len(s) else least
    fits = s >= (bound - slack)[a]
    a, b = a[fits], b[fits]
    s = exact(q[a], x[b])
    order = np.lexsort((first[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    few = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[few], b[few], s[few]


def fitted_probes(classes: DataFrame, queries: DataFrame, hasher: Hasher, most: dict[int, float], k: int, sample: int, recall: float) -> int:
    """Probes of a table with which ``recall`` of the sample's nearest classes are found; all classes are compared with it."""
    picked = queries.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    if not picked:
        return 1
    width = hasher.width
    keys, q = np.array([r.key for r in picked]), np.zeros((len(picked), width))
    for row, r in zip(q, picked, strict=True):
        row[: len(r.v)] = r.v
    sent = send(classes.sparkSession, (hasher, keys, q, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        hasher, keys, q, most = received(sent)
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        for batch in slices(batches, HELD):
            key, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            a, b, s = nearest(q, x, iter([(np.arange(len(q)), np.arange(len(x)))]), key, k + 1)
            fresh = keys[a] != key[b]
            a, b, s = a[fresh], b[fresh], s[fresh]
            unit = hasher.unit(x, batch.column(2).to_numpy(), np.array([most[m] for m in batch.column(3).to_pylist()]))
            point, place = hasher.unit(q), np.empty(len(a), np.int64)
            for one in np.unique(a):
                place[a == one] = hasher.places(point[one], unit[b[a == one]])
            a, s, place = (np.concatenate(two) for two in zip(best, (a, s, place), strict=True))
            order = np.lexsort((-s, a))
            a, s, place = a[order], s[order], place[order]
            few = np.arange(len(a)) - np.searchsorted(a, a) < k
            best = (a[few], s[few], place[few])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["q", "s", "place"])

    found = classes.select("key", "v", "norm", "band").mapInArrow(run, "q long, s double, place long")
    order = W.partitionBy("q").orderBy(F.col("s").desc(), "place")
    places = [r.place for r in found.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= k).select("place").collect()]
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1


def _dealt(entries: DataFrame, probes: DataFrame, cell: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part`` and ``qpart``: blocks of about ``cell`` classes by ``cell`` queries in each cell."""
    at = ["at", "cell"]
    sized = entries.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    asked = probes.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("qparts"))
    both = stored(sized.join(asked, at), f"{name}-cells")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = entries.join(both, at).withColumn("part", own("parts")).withColumn("qpart", every("qparts"))
    q = probes.join(both, at).withColumn("qpart", own("qparts")).withColumn("part", every("parts"))
    return e.drop("parts", "qparts"), q.drop("parts", "qparts")


def searched(classes: DataFrame, queries: DataFrame, hasher: Hasher, most: dict[int, float], probes: int, k: int, cell: int, name: str) -> DataFrame:
    """(key, found): for each row of ``queries`` (key, v) its k nearest (vec_id, score) among probed buckets, nearest first."""
    spark, width = classes.sparkSession, hasher.width
    sent = send(spark, (hasher, most, probes, max(1, cell * hasher.buckets // max(1, classes.count()))))
    bands = sorted(most)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, most, _, span = received(sent)
        for batch in slices(batches, HELD):
            unit = hasher.unit(matrix(batch.column(1), width), batch.column(3).to_numpy(), np.array([most[m] for m in batch.column(4).to_pylist()]))
            shift = np.array([bands.index(m) for m in batch.column(4).to_pylist()], np.int64) * hasher.buckets
            for at in range(hasher.tables):
                bucket = hasher.buckets_of(unit, at) + shift
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), at, np.int32)), pa.array(bucket // span), pa.array(bucket), *batch.columns[:3]], ["at", "cell", "bucket", "key", "v", "ids"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, _, probes, span = received(sent)
        for batch in slices(batches, HELD):
            unit = hasher.unit(matrix(batch.column(1), width))
            for at in range(hasher.tables):
                best = hasher.probed(unit, at, probes)
                for band in range(len(bands)):
                    bucket = np.sort(best + band * hasher.buckets, axis=1)
                    row, cells = np.repeat(np.arange(len(unit)), bucket.shape[1]), (bucket // span).ravel()
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (cells[1:] != cells[:-1])
                    start = np.nonzero(new)[0]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(bucket.ravel()))
                    kept = batch.take(pa.array(row[start]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), at, np.int32)), pa.array(cells[start]), lists, kept.column(0), kept.column(1)], ["at", "cell", "buckets", "key", "v"])

    kind = dict(classes.dtypes)["v"]
    e = stored(classes.select("key", "v", "ids", "norm", "band").mapInArrow(entries, f"at int, cell long, bucket long, key long, v {kind}, ids array<long>"), f"{name}-entries")
    q = stored(queries.select("key", "v").mapInArrow(probing, f"at int, cell long, buckets array<long>, key long, v {kind}"), f"{name}-probes")
    e, q = _dealt(e, q, cell, name)

    def block(entries: pa.Table, asked: pa.Table) -> pa.Table:
        one_thread()
        x, qs = (matrix(t["v"].combine_chunks(), width) for t in (entries, asked))
        first, ids = entries["key"].to_numpy(), entries["ids"].combine_chunks()
        bucket = entries["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, start = np.unique(bucket[order], return_index=True)
        rows = np.split(order, start[1:]) if len(names) else []
        lists = asked["buckets"].combine_chunks()
        who, which = np.repeat(np.arange(len(qs)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        by = np.argsort(which, kind="stable")
        which, who = which[by], who[by]
        lo, hi = np.searchsorted(which, names), np.searchsorted(which, names, side="right")
        pairs = ((who[i:j], b) for i, j, b in zip(lo, hi, rows, strict=True) if j > i)
        a, b, s = nearest(qs, x, pairs, first, k)
        # every id of the classes found, and again the k best
        n, offset = ids.value_lengths().to_numpy(), ids.offsets.to_numpy()
        times = n[b]
        at = np.repeat(offset[b] - offset[0] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        a, s, vec = np.repeat(a, times), np.repeat(s, times), ids.flatten().to_numpy()[at]
        order = np.lexsort((vec, -s, a))
        a, s, vec = a[order], s[order], vec[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, s, vec = a[few], s[few], vec[few]
        has, begin = np.unique(a, return_index=True)
        ends = pa.array(np.append(begin, len(a)).astype(np.int32))
        keys = asked["key"].to_numpy()
        return pa.table({"key": pa.array(keys[has], pa.int64()), "s": pa.ListArray.from_arrays(ends, pa.array(s, pa.float64())), "i": pa.ListArray.from_arrays(ends, pa.array(vec, pa.int64()))})

    on = ["at", "cell", "part", "qpart"]
    found = e.groupBy(*on).cogroup(q.groupBy(*on)).applyInArrow(block, "key long, s array<double>, i array<long>")
    each = F.transform(F.arrays_zip("s", "i"), lambda x: F.struct((-x["s"]).alias("s"), x["i"].alias("i")))
    best = found.groupBy("key").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(each)))), 1, k).alias("found"))
    return best.select("key", F.transform("found", lambda x: F.struct(x["i"].alias("vec_id"), (-x["s"] + F.lit(0.0)).alias("score"))).alias("found"))


def neighbours(
    df: DataFrame, is_query: Column, column: str = "embedding", k: int = K, tables: int = TABLES, hashes: int | None = None, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL,
    seed: int = SEED, name: str = "neighbours",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row of ``df`` (vec_id, ``column``) with ``is_query``, itself left out."""
    rows = stored(usable(df, column), f"{name}-rows")
    classes = stored(classes_of(rows, k + 1), f"{name}-classes")
    asked = rows.where(is_query)
    queries = stored(asked.groupBy("h", "v").agg(F.min("vec_id").alias("key")), f"{name}-queries")
    width, n = classes.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    most = {r.band: r.most for r in classes.groupBy("band").agg(F.max("norm").alias("most")).collect()}  # a band for each power of two
    hasher = Hasher(width or 1, tables, hashes or (1 if n < TWO_HASHES else 2), seed)
    probes = fitted_probes(classes, queries, hasher, most, k, sample, recall)
    found = stored(searched(classes, queries, hasher, most, probes, k + 1, cell, name), f"{name}-found")
    named = asked.join(queries.join(found, "key"), ["h", "v"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = named.select(F.col("vec_id").alias("query_id"), F.posexplode(others))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of all embeddings for those whose vec_id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0, name="op12")
