"""Ranked search, neighbours and importance resampling against plain versions, and their edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from granula.llm import cross_polytope, importance, lexical, registry
from granula.llm.terms import terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("text", [None, "", " \t", "One two-THREE 4x", "ÀÉ É_x ß漢字 a b", "\u0080a~b\x7fc{d", "🙂A"])
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in terms(text.encode() if text is not None else None)] == TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    """All scores of all documents."""
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scores = []
        for i, c in split:
            m = 75 + 25 * c.total() * n_docs // total if total else 0
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


DOCS = [
    (1, "alpha beta gamma", "x"), (1, "alpha beta gamma", "x"), (2, "ALPHA alpha beta", "x"), (3, None, None), (4, "", "x"), (5, " .,; ", "x"), (None, "gamma delta gamma", "x"), (6, "common " * 30_000 + "rare", "x"),
    (7, "common delta", "x"), (8, "delta common", "x"), (9, "common", "x"), (10, "common alpha", "x"),
]


@pytest.mark.parametrize("k", [1, 2, 20])
def test_ranking_of_edge_rows(spark, k):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, term string, row int, n int")
    rows = [(1, "alpha beta alpha"), (2, "common"), (3, None), (4, "unknown"), (5, "rare gamma, DELTA"), (6, "")]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, item string")
    got = sorted((tuple(r) for r in lexical.ranked(docs, items, k=k).collect()), key=str)
    assert got == plain_ranking([d[:2] for d in DOCS], rows, k)
    assert lexical.ranked(docs.where("false"), items).count() == 0 and lexical.ranked(docs, items.where("false")).count() == 0


def test_ranking_with_skipped_lists(spark):
    """Thresholds leave lists and documents out, and the result stays exact."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    weight = 1 / np.arange(1, 61)
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 40), p=weight / weight.sum()))) for k in range(600)]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 12)))) for k in range(25)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.ranked(*frames, k=3).collect()), key=str)
    assert got == plain_ranking(docs, items, 3)


def test_checksums_of_two_words_from_those_of_each():
    words = [b"a", b"zz", "é".encode(), b"x" * 63, b"y" * 64, b"z" * 300]
    text = b" ".join([a + b" " + b for a in words for b in words])
    found = terms(text)
    bucket, owner, n = importance.Features(10_000)([None, text, b"", b"one"])
    grams = [f for f in found] + [a + b" " + b for a, b in zip(found, found[1:], strict=False)]
    assert sorted(bucket[owner == 1].tolist()) == sorted(zlib.crc32(g) % 10_000 for g in grams)
    assert n.tolist() == [0, len(found), 0, 1] and (owner == 3).sum() == 1


def plain_draw(docs, target, percent=25, least=20, buckets=10_000):
    def features(text):
        w = TERM.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in rows), key=str)


def test_importance_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = registry.queries()["op13_importance"](spark, SF)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain_draw(docs, target)


@pytest.mark.parametrize("least,percent", [(1, 25), (1, 100), (3, 50), (20, 25), (1, 0)])
def test_importance_of_edge_rows(spark, least, percent):
    ties = [(k, "one two three", "x") for k in (-5, 2**62, -(2**62), 12)] + [(70_000, "one two three", "x")] * 3
    rows = [*DOCS, *ties]
    docs = spark.createDataFrame([(*d, 1) for d in rows], "doc_id long, text string, weight string, row int")
    target = spark.createDataFrame([("alpha beta",), (None,), ("",)], "text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    got = importance.resampled(docs, target, percent=percent, least_words=least).select(cols).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_draw([d[:2] for d in rows], ["alpha beta", None, ""], percent, least)
    assert importance.resampled(docs.where("false"), target).count() == 0
    empty = importance.resampled(docs, target.where("false"), percent=percent, least_words=least).select(cols).collect()
    assert sorted((tuple(r) for r in empty), key=str) == plain_draw([d[:2] for d in rows], [], percent, least)


def test_selection_is_exact_with_equal_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(rng.integers(-2, 2)) * 10 ** int(k2)) for k, k2 in zip(rng.permutation(3000) - 1500, rng.integers(0, 12, 3000), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, score long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert sorted(map(tuple, df.where(importance.up_to_kth(df, k, "score", "doc_id")).collect())) == sorted(order[:k])


def plain_neighbours(rows, k, every):
    x = {i: np.array(v) for i, v in rows}
    out = {}
    for q in (i for i in x if i % every == 0):
        scored = [(-float(cross_polytope.exact(x[q][None], x[i][None])[0]), i) for i in x if i != q]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_neighbours_reach_their_recall(spark):
    got = {}
    for r in registry.queries()["op12_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_neighbours(rows, 20, 20)
    assert got.keys() == want.keys()
    scores = {q: dict(v) for q, v in plain_neighbours(rows, len(rows), 20).items()}
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [v for _, v, _ in sorted(found)] == [v for _, v, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        assert all(scores[q][v] == s for _, v, s in found)  # to the last bit
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("hashes,cell", [(1, 4096), (2, 4096), (1, 8), (2, 8)])
def test_neighbours_of_lengths_copies_and_small_blocks(spark, hashes, cell):
    """Vectors of unlike norms, many exact copies (ties by id) and cells in many parts; with full recall the result is exact."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 6)).astype(np.float32).astype(float) * 10.0 ** rng.integers(-2, 3, (150, 1))
    rows = [(k, base[k % 150 if k < 250 else 3].tolist()) for k in range(330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cross_polytope.neighbours(df, F.col("vec_id") % 20 == 0, k=7, hashes=hashes, cell=cell, recall=1.0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, want in plain_neighbours(rows, 7, 20).items():
        assert [(v, s) for _, v, s in sorted(got[q])] == want


def test_neighbours_of_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"), (3, [], "x"), (4, [0.0, 0.0], "x"), (5, [1.0, None], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (None, [1.0, 1.0], "x"),
        (20, [2.0], "x"), (20, [2.0], "x"), (40, None, "x"), (8, [-1.0, 0.0, 3.0], "x"), (60, [3.0, 0.0], "x"), (60, [1.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cross_polytope.neighbours(df, F.col("vec_id") % 20 == 0, recall=1.0).collect())
    kept = [(0, [1.0, 0.0, 0.0]), (1, [0.5, 0.5, 0.0]), (20, [2.0, 0.0, 0.0]), (8, [-1.0, 0.0, 3.0]), (60, [1.0, 0.0, 0.0])]
    assert got == [(q, k + 1, v, s) for q, found in sorted(plain_neighbours(kept, 20, 20).items()) for k, (v, s) in enumerate(found)]
    assert cross_polytope.neighbours(df.where("false"), F.lit(True)).count() == 0
    assert cross_polytope.neighbours(df, F.lit(False)).count() == 0
    assert cross_polytope.neighbours(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_small_tables_through_sql_of_the_ranking(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(con.sql(lexical.ORACLE).fetchall(), key=str) == plain_ranking(docs, items, 20)
