"""Importance resampling towards a target: array-scored weights, then radix selection.

1. Features are all runs of one and two words, counted in ``BUCKETS`` by CRC-32. A task adds
   up one array over its rows; arrays are summed by bucket, whatever the number of rows. The
   CRC of two words comes from those of each by the linear step of the checksum, in arrays.
2. The gains of all buckets are one array of fixed size that travels to the tasks; a
   document's weight is the floored mean over its features.
3. Seeded Gumbel noise makes the k highest scores a draw without replacement. The exact k-th
   key (falling score, rising doc_id) is found digit by digit: each round counts the 65,536
   values of the next 16 bits among the rows that share all digits before.
4. Only the rows up to that key are sorted, by ranges; a row's rank is its place in its range
   and the rows of the ranges before.

Defined results: null, empty and wordless texts have no features and weight 0; null doc_ids
take the noise of ``seed:`` alone and lose ties; rows of one score and doc_id are ordered by
n_features and weight, repeated rows among themselves in any order, each a row of the result;
an empty table gives an empty result, an empty target makes all gains depend on the documents
alone; a very long text is one document, read whole; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.base import received, send, slices, stored, table
from granula.llm.terms import HELD, terms, utf8

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Distinct words that a worker knows at once, and the longest second word whose checksum step is a table.
CACHE, STEPS = 200_000, 64
DIGIT = 16


def crc_steps() -> np.ndarray:
    """steps[n, k, b]: what byte k of value b of a CRC-32 becomes when n bytes follow; the checksum is linear in it."""
    return np.array([[[zlib.crc32(bytes(n), b << 8 * k) ^ zlib.crc32(bytes(n)) for b in range(256)] for k in range(4)] for n in range(STEPS)], np.uint32)


class Features:
    """Bucket numbers of the features of texts; words are known up to a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.steps = buckets, crc_steps()
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.known = 0
        self.own, self.before, self.size = (np.empty(0, t) for t in (np.uint32, np.uint32, np.int64))

    def _learn(self) -> None:
        new = self.words[self.known :]
        if new:
            add = lambda old, values: np.concatenate([old, np.array(values, old.dtype)])
            self.own = add(self.own, [zlib.crc32(w) for w in new])
            self.before = add(self.before, [zlib.crc32(w + b" ") for w in new])
            self.size = add(self.size, [len(w) for w in new])
            self.known = len(self.words)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, place of its text, words of each text), a bucket for each feature."""
        if len(self.words) > CACHE:
            self._forget()
        at, words, ids, n = self.at, self.words, [], []
        for text in texts:
            found = terms(text)
            for w in set(found).difference(at):
                at[w] = len(words)
                words.append(w)
            ids.append(np.fromiter(map(at.__getitem__, found), np.int64, len(found)))
            n.append(len(found))
        self._learn()
        n, ids = np.array(n, np.int64), np.concatenate(ids) if ids else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        one = self.own[ids]
        follows = np.nonzero(owner[1:] == owner[:-1])[0]
        a, b = self.before[ids[follows]], ids[follows + 1]
        size = np.minimum(self.size[b], STEPS - 1)
        two = self.own[b].copy()
        for k in range(4):
            two ^= self.steps[size, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
        for k in np.nonzero(self.size[b] >= STEPS)[0].tolist():  # long second words
            two[k] = zlib.crc32(self.words[b[k]], int(a[k]))
        return np.concatenate([one, two]) % np.uint32(self.buckets), np.concatenate([owner, owner[follows]]), n


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of the one column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, HELD):
            total += np.bincount(features(batch.column(0).to_pylist())[0], minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(utf8(F.col("text")).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, name: str = "gains") -> np.ndarray:
    """One gain for each bucket: floor(1000 ln of the smoothed odds of the target)."""
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    both = bucket_counts(docs, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    both = stored(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left"), f"{name}-buckets")
    totals = both.agg(F.coalesce(F.sum(s), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum(t), F.lit(0.0)).alias("all_t"))
    gain = F.floor(F.lit(1000.0) * F.log((t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets)))).cast("long")
    found = both.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain")).collect()  # one row of totals; ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in found]] = [r.gain for r in found]
    return out


def weighted(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of (doc_id, text)."""
    sent = send(docs.sparkSession, gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(sent)
        features = Features(len(own))
        for batch in slices(batches, HELD):
            bucket, owner, words = features(batch.column(2).to_pylist())
            n = np.bincount(owner, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, owner, own[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (words, n, weight))], ["row", "doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    rows = rows.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def _digits(falling: Column, high: int, rising: Column) -> list[Column]:
    """The key as 16-bit digits, highest first: ``falling`` subtracted from its maximum, null after all others, ``rising`` in signed order."""
    down, up = F.lit(high) - falling, F.coalesce(rising, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))
    cut = lambda c: [F.shiftrightunsigned(c, k).bitwiseAND(F.lit(2**DIGIT - 1)) for k in range(64 - DIGIT, -1, -DIGIT)]
    return [*cut(down), F.when(rising.isNull(), 1).otherwise(0).cast("long"), *cut(up)]


def up_to_kth(rows: DataFrame, k: int, falling: str, rising: str) -> Column:
    """A condition that holds for the k least keys (falling, rising) of ``rows`` and for all rows equal to the k-th.

    A round reads two columns and counts at most 65,536 digits; rounds end as soon as a
    digit's rows are all in.
    """
    if k <= 0:
        return F.lit(False)
    high = rows.agg(F.max(falling)).first()[0]
    taken, prefix = F.lit(False), F.lit(True)
    for digit in _digits(F.col(falling), high, F.col(rising)):
        counts = sorted((r.d, r.n) for r in rows.where(prefix).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for d, n in counts:
            if n >= k:
                break
            k -= n
        taken, prefix = taken | (prefix & (digit < d)), prefix & (digit == d)
        if n == k:
            break
    return taken | prefix


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, name: str = "drawn") -> DataFrame:
    """All ``rows`` (as of weighted()) with rank: 1, 2, ... of the floor(percent * N / 100) highest scores, null for others."""
    rows = stored(rows, f"{name}-scores")
    fit = rows.where(F.col("n_words") >= least_words)
    k = fit.count() * percent // 100
    taken = (F.col("n_words") >= least_words) & up_to_kth(fit, k, "score", "doc_id")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # after the sort this id is the number of the range and the place in it
    best = rows.where(taken).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    best = stored(best, f"{name}-best").withColumn("__range", F.shiftright("__place", 33))
    before, start = {}, 0
    for r in sorted(best.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row for each partition
        before[r[0]], start = start, start + r.n
    if before:
        offset = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv]), F.col("__range"))
    else:
        offset = F.lit(0).cast("long")
    rank = offset + F.col("__place").bitwiseAND(F.lit(2**33 - 1)) + 1
    best = best.withColumn("rank", F.when(rank <= k, rank)).drop("__place", "__range")  # rows equal to the k-th, past k
    return best.unionByName(rows.where(~taken).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, name: str = "resampled") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    return drawn(weighted(docs, gains(docs, target, buckets, name), seed), percent, least_words, name)


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark texts."""
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampled(docs, target, name="op13").select("doc_id", "n_features", "weight", "score", "rank")
