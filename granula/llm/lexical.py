"""Ranked lexical search by three rounds of thresholds (TPUT) over term-partitioned postings.

1. The documents are read once, in slices of up to SLICE rows. A slice gives a packed posting
   list for each of its terms that some item asks for, and one of the empty term with the
   length of every document. Sums over these lists give N, L and every df.
2. What a posting adds to a score (weight times saturated frequency, 64-bit integers) depends
   on its term and document alone. ``lists`` holds it, highest first, partitioned by ranges
   of term and slice: a very common term spreads over many pieces of bounded length.
3. Round one fetches the head of every list, its ``k`` highest impacts. The k-th highest sum
   of an item's heads is a lower bound t of its k-th score.
4. Round two reads from each list of an item with m lists the postings that add t / m or
   more; a document with no such posting stays below t. A slice adds them up in arrays, for
   blocks of items, and passes on the documents whose upper bound (their sum and the next
   value of each list that was not read for them) reaches t and the slice's own k-th sum.
5. The k-th highest sum over all slices is a better bound. Round three looks up what is
   missing of the documents whose upper bound reaches it, in the lists by (slice, term).

No round holds a list in one task: heads are cut before the shuffle, and a task of round two
holds one slice by one block of items.

Defined results: a null or empty text, and one without terms, is no document of N and no
result; an item without terms has no rows; equal scores rank by doc_id, null ids last; every
row is a document of its own, so repeated rows (or ids) stand side by side; every row of
``items`` is an item of its own; empty tables give an empty result; a very long text is read
whole; other columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.llm.base import received, send, slices, stored, table
from granula.llm.terms import COUNTED, counted, each_term, strings, terms, utf8

K = 20
#: Documents of a slice and items of a block.
SLICE, ITEMS = 4096, 512
#: Up to so many asked terms travel with the tasks that read documents; more meet them in a join alone.
SHIPPED = 200_000
#: Lists that a Python worker holds at once.
HELD_LISTS = 256
#: The list that holds every document.
ALL = ""


def _asked(items: DataFrame, name: str) -> DataFrame:
    """(item, item_id, term, qtf): the terms of every item."""
    rows = stored(items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("text")), f"{name}-items")
    found = rows.select("key", "text").mapInArrow(counted, COUNTED).select(F.col("key").alias("item"), F.explode(each_term()).alias("t"))
    found = found.select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("qtf"))
    return stored(found.join(rows.select(F.col("key").alias("item"), "item_id"), "item"), f"{name}-asked")


def _lists(names: list[bytes], size: np.ndarray, kinds: dict[str, pa.Array]) -> dict[str, pa.Array]:
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return {"term": strings(names)} | {c: pa.ListArray.from_arrays(ends, v) for c, v in kinds.items()}


def postings(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(slice, term, rows, tfs, ns, ids): lists of the terms in ``wanted``, and of ALL with the doc_ids; rows count from 0 in a slice."""
    few = [r.term.encode() for r in wanted.limit(SHIPPED + 1).collect()]
    sent = send(docs.sparkSession, set(few) if len(few) <= SHIPPED else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = received(sent)
        for batch in slices(batches, SLICE):
            known, at, row, tf, size = {}, [], [], [], np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(2)):
                found = Counter(terms(text.as_py()))
                size[k] = found.total()
                some = found if asked is None else found.keys() & asked
                at.extend(known.setdefault(t, len(known)) for t in some)
                tf.extend(found[t] for t in some)
                row.extend([k] * len(some))
            at, row, tf = np.array(at, np.int64), np.array(row, np.int32), np.array(tf, np.int64)
            order = np.argsort(at, kind="stable")
            full = np.nonzero(size)[0]
            if not len(full):
                continue
            names, n = [ALL.encode(), *known], np.concatenate([[len(full)], np.bincount(at, minlength=len(known))])
            join = lambda a, b, t: pa.array(np.concatenate([a, b]).astype(t))
            out = _lists(names, n, {"rows": join(full, row[order], np.int32), "tfs": join(np.ones(len(full)), tf[order], np.int64), "ns": join(size[full], size[row[order]], np.int64)})
            ids = pa.ListArray.from_arrays(pa.array(np.array([0] + [len(full)] * len(n), np.int32)), batch.column(1).take(pa.array(full)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * len(n), pa.int64()), *out.values(), ids], ["slice", *out, "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    found = rows.mapInArrow(run, "slice long, term string, rows array<int>, tfs array<long>, ns array<long>, ids array<long>")
    return stored(found if len(few) <= SHIPPED else found.join(wanted.union(wanted.sparkSession.createDataFrame([(ALL,)], "term string")), "term", "left_semi"), f"{name}-postings")


def lists(found: DataFrame, name: str) -> DataFrame:
    """(term, slice, rows, cs): what every posting adds, highest first and over 0; ``found`` as of postings()."""
    summed = found.groupBy("term").agg(F.sum(F.size("rows")).alias("df"), F.sum(F.when(F.col("term") == ALL, F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n))).alias("all"))
    known = stored(summed, f"{name}-terms")
    whole = known.where(F.col("term") == ALL).select(F.col("df").alias("docs"), F.col("all").alias("total"))
    weighed = known.where(F.col("term") != ALL).crossJoin(F.broadcast(whole))  # one row
    w = F.floor(F.lit(1000.0) * F.log((2.0 * F.col("docs") + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = weighed.select("term", "docs", "total", w.alias("w")).where("w > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD_LISTS):
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("rows", "tfs", "ns")}
            size = batch.column("rows").value_lengths().to_numpy()
            each = np.repeat(np.arange(len(size)), size)
            w, docs, total = (batch.column(c).to_numpy()[each] for c in ("w", "docs", "total"))
            m = 75 + (25 * flat["ns"] * docs) // total
            c = w * ((10**9 * flat["tfs"]) // (1000 * flat["tfs"] + 12 * m))
            order = np.lexsort((flat["rows"], -c, each))
            order = order[c[order] > 0]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(each[order], minlength=len(size)))]).astype(np.int32))
            both = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (flat["rows"], c)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("slice"), *both], ["term", "slice", "rows", "cs"])

    out = found.select("slice", "term", "rows", "tfs", "ns").join(weighed, "term").mapInArrow(run, "term string, slice long, rows array<int>, cs array<long>").where(F.size("cs") > 0)
    return stored(out.repartitionByRange("term", "slice"), f"{name}-lists")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th highest of (item, s), for items that have k."""
    order = W.partitionBy("item").orderBy(F.col("s").desc())
    few = scores.select("item", "s", F.row_number().over(order).alias("__at")).where(F.col("__at") <= k)
    return few.groupBy("item").agg(F.count(F.lit(1)).alias("found"), F.min("s").alias("least")).where(F.col("found") == k).select("item", "least")


def _summed(k: int):
    """Round two in one slice: sums and upper bounds of its documents for one block of items."""

    def run(pieces: pa.Table, asked: pa.Table) -> pa.Table:
        at = {t: i for i, t in enumerate(pieces["term"].to_pylist())}
        rows, cs = (pieces[c].combine_chunks() for c in ("rows", "cs"))
        end = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        rows, cs = rows.flatten().to_numpy(), cs.flatten().to_numpy()
        n, by = rows.max(initial=-1) + 1, {}
        for item, term, q, below, t in zip(*(asked[c].to_pylist() for c in ("item", "term", "qtf", "below", "t")), strict=True):
            by.setdefault((item, below, t), []).append((at.get(term), q))
        out = []
        for (item, below, t), lists in by.items():
            s, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, q in lists:
                if i is None:
                    continue
                c, r = cs[end[i] : end[i + 1]], rows[end[i] : end[i + 1]]
                cut = int(np.searchsorted(-c, -(below // q)))
                s[r[:cut]] += q * c[:cut]
                if cut < len(c):
                    rest += q * c[cut]
                    rest[r[:cut]] -= q * c[cut]
            met = np.nonzero(s)[0]
            least = max(t, int(np.partition(s[met], len(met) - k)[len(met) - k]) if len(met) >= k else 0)
            met = met[s[met] + rest[met] >= least]
            out.append((np.full(len(met), item), met, s[met], rest[met]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(4)]
        one = np.full(len(cols[0]), pieces["slice"][0].as_py() if len(pieces) else 0)
        return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(("item", "slice", "row", "s", "rest"), (cols[0], one, *cols[1:]), strict=True)})

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = K, name: str = "lexical") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    asked = _asked(items, name)
    found = postings(docs, asked.select("term").distinct(), name)
    at = lists(found, name)

    # round one: list heads and a lower bound for each item
    few = F.slice(F.arrays_zip("rows", "cs"), 1, k)
    heads = at.select("term", "slice", F.explode(few).alias("p")).select("term", "slice", F.col("p.rows").alias("row"), F.col("p.cs").alias("c"))
    order = W.partitionBy("term").orderBy(F.col("c").desc(), "slice", "row")
    heads = stored(heads.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= k), f"{name}-heads")
    first = heads.join(asked, "term").groupBy("item", "slice", "row").agg(F.sum(F.col("qtf") * F.col("c")).alias("s"))
    own = asked.join(heads.select("term").distinct(), "term", "left_semi")  # lists that are not empty
    m = own.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    t = F.coalesce(F.col("least"), F.lit(0).cast("long"))
    below = F.when(t > 0, F.call_function("div", t - 1, F.col("m"))).otherwise(F.lit(0).cast("long"))  # the most that a posting adds unread
    own = own.join(m, "item").join(_kth(first, k), "item", "left").select("item", "item_id", "term", "qtf", t.alias("t"), below.alias("below"))
    own = stored(own, f"{name}-bounds")

    # round two: what passes the uniform threshold, added up by slices
    blocks = max(1, -(-own.select("item").distinct().count() // ITEMS))
    parts = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every = found.select("slice").distinct().withColumn("block", parts)
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    dealt = own.select("item", "term", "qtf", "below", "t", block.alias("block")).join(every, "block")  # the items against every slice
    met = at.withColumn("block", parts).groupBy("slice", "block").cogroup(dealt.groupBy("slice", "block")).applyInArrow(_summed(k), "item long, slice long, row long, s long, rest long")
    met = stored(met, f"{name}-met")

    # round three: the exact scores of what can still be among the best
    chosen = met.join(_kth(met, k), "item", "left").where(F.col("s") + F.col("rest") >= F.coalesce(F.col("least"), F.lit(0).cast("long")))
    chosen = stored(chosen.select("item", "slice", "row", "s", "rest"), f"{name}-chosen")
    wanted = chosen.where("rest > 0").join(own, "item").groupBy("slice", "term", block.alias("block")).agg(F.collect_list(F.struct("item", "row", "qtf", "below")).alias("wanted"))
    place = lambda x: F.array_position("rows", x["row"].cast("int"))
    looked = at.join(wanted, ["slice", "term"]).select("slice", F.explode(F.transform("wanted", lambda x: F.struct(x["item"].alias("item"), x["row"].alias("row"), (x["qtf"] * F.get("cs", (place(x) - 1).cast("int"))).alias("s"), x["below"].alias("below")))).alias("x"))
    looked = looked.where("x.s <= x.below").select("x.item", "slice", "x.row", "x.s")
    exact = chosen.select("item", "slice", "row", "s").union(looked).groupBy("item", "slice", "row").agg(F.sum("s").alias("score"))
    # ids come before the cut, as they decide ties
    docs_of = found.where(F.col("term") == ALL).select("slice", F.map_from_arrays("rows", "ids").alias("ids"))
    named = exact.join(docs_of, "slice").select("item", "score", "slice", "row", F.element_at("ids", F.col("row").cast("int")).alias("doc_id"))
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "slice", "row")
    best = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return best.join(own.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked(docs.select("doc_id", "text"), items.select("item_id", "text"), name="op11")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: All contributions of all documents, summed.
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM documents),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))) AS c FROM p JOIN w ON p.term = w.term, s),
x AS (SELECT item_id, r, doc_id, sum(qtf * c)::BIGINT AS score FROM c JOIN q ON c.term = q.term GROUP BY ALL HAVING sum(qtf * c) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {K}
"""
