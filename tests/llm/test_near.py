"""Long lists of the near-duplicate operator: small blocks against brute force, rows linear in near copies."""

import random

import pytest
from conftest import SF
from test_edges import _components

from granula.llm import near_dedup


@pytest.fixture(scope="module")
def tangled(spark):
    """Chains of near copies, unlike texts with common shingles, and copies, in one set of long lists."""
    rng, rows = random.Random(7), []
    base = [f"w{k}" for k in range(60)]
    for family in range(3):
        text = [*base[:20], *(f"f{family}x{k}" for k in range(30))]
        for _ in range(25):  # each a step from the one before
            text = list(text)
            text[rng.randrange(50)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rows += [" ".join([*base[:20], *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40)))]) for _ in range(40)]
    rows += rows[:10] + [" ".join(base[: rng.randrange(2, 60)]) for _ in range(30)]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block,pivots,long_list", [(2, 1, 2), (2, 0, 1), (5, 2, 3), (128, 16, 1)])
def test_blocks_give_the_components_of_all_pairs(spark, tangled, block, pivots, long_list):
    docs = spark.createDataFrame(tangled, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2, block=block, pivots=pivots, long_list=long_list).collect()}
    assert got == _components(tangled, 2)


def test_small_blocks_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2, block=2, pivots=1, long_list=1).collect()}
    assert got == _components([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_rows_are_linear_in_near_copies(spark, monkeypatch):
    rng, base, kept = random.Random(1), [f"w{k}" for k in range(120)], {}
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, real=near_dedup.stored: kept.setdefault(name, real(df, name)))
    seen = {}
    for m in (400, 1600):
        rows = []
        for k in range(m):
            text = list(base)
            for _ in range(3):
                text[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
            rows.append((k, " ".join(text)))
        kept.clear()
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, name="n")
        assert found.select("component_id").distinct().count() == 1
        met = near_dedup._with_pivots(kept["n-blocks"], near_dedup.PIVOTS).count()
        seen[m] = met + kept["n-left"].count()
    assert seen[1600] < 6 * seen[400]


def test_clashing_extra_columns(spark):
    """Columns named like those of the operator come back with their own values."""
    docs = spark.createDataFrame([(1, "a b c", 7, 8, "p", "q"), (2, "a b c", 9, 10, "r", "s")], "doc_id long, text string, h int, n_shingles int, fp string, sketch string")
    extra = ["h", "n_shingles", "fp", "sketch"]
    with pytest.raises(ValueError, match="h, n_shingles, fp, sketch"):
        near_dedup.near_duplicates(docs, extra=extra)


def test_only_possible_partners_meet_with_full_sets(spark):
    rows = [("v", 1, 1), ("v", 2, 2), ("v", 3, 3), ("w", 1, 1), ("w", 2, 2)]
    rows = spark.createDataFrame([(c, i, r) for c, i, r in rows], "cluster string, fp long, root long")
    full = [*range(32)]
    marks = spark.createDataFrame([(1, 40, full, ["v", "w"]), (2, 40, full[:20] + [*range(50, 62)], ["v", "w"]), (3, 40, full[:2] + [*range(70, 100)], ["v"])], "fp long, size int, sketch array<long>, clusters array<string>")
    found = lambda once: sorted(tuple(r) for r in near_dedup._may_link(rows, marks, ["cluster"], 80, 32, 14, once).collect())
    assert found(False) == [("v", 1, 1), ("v", 2, 2), ("w", 1, 1), ("w", 2, 2)]
    assert found(True) == [("v", 1, 1), ("v", 2, 2)]
