"""Shifts and exact rank tests of many pairs at once against all differences and all splits."""

from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import stats

PAIRS = {
    "separated": ([1.1, 2.2, 3.3, 4.4], [5.5, 6.6, 7.7, 8.8]),
    "interleaved": ([1.0, 3.0, 5.0, 7.0], [2.0, 4.0, 6.0, 8.0]),
    "tied": ([1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 3.0]),
    "half_ranks": ([1.0, 1.0, 1.0, 4.0, 5.0], [1.0, 4.0, 4.0, 9.0]),
    "alike": ([2.0, 2.0, 2.0], [2.0, 2.0]),
    "single": ([1.0], [2.0, 3.0, 4.0]),
    "floor": ([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0]),
    "ten": ([float(k) for k in range(10)], [k + 0.5 for k in range(3, 13)]),
}


def every_split(a, b):
    pooled = np.array([*a, *b])
    ranks = np.array([(pooled < x).sum() + ((pooled == x).sum() + 1) / 2 for x in pooled])
    centre, k = len(a) * (len(pooled) + 1) / 2, len(a)
    far = abs(ranks[:k].sum() - centre) - 1e-9
    return sum(abs(ranks[list(c)].sum() - centre) >= far for c in combinations(range(len(pooled)), k)) / comb(len(pooled), k)


def frame(spark, pairs):
    rows = [(name, g, float(v)) for name, both in pairs.items() for g, values in zip("ab", both, strict=True) for v in values]
    return spark.createDataFrame([*rows, ("nothing", "a", None)], "family string, group string, value double")


def test_exact_p_is_that_of_every_split(spark):
    found = {r.family: r for r in stats.mann_whitney(frame(spark, PAIRS), ["family"]).collect()}
    assert found.keys() == PAIRS.keys()
    for name, (a, b) in PAIRS.items():
        if name in ("alike", "single"):
            assert found[name].p is None and found[name].method is None
        else:
            assert found[name].p == pytest.approx(every_split(a, b), abs=1e-12)
            assert found[name].method == ("permutation" if len({*a, *b}) < len(a) + len(b) else "exact")
    assert found["floor"].p == pytest.approx(2 / 35) and found["separated"].p == pytest.approx(2 / 70)


@pytest.mark.parametrize("n1,n2", [(4, 4), (3, 7), (6, 6)])
def test_counts_of_rank_sums_are_all_arrangements(spark, n1, n2):
    ties = F.array_repeat(F.lit(1), n1 + n2)
    n = n1 + n2
    ways = spark.range(1).select(stats.exact_ways(stats.doubled_ranks(ties), F.lit(n1), F.lit(n * (n + 1) + 1))).first()[0]
    u = [w for s, w in enumerate(ways) if w]  # sums of doubled ranks are even
    assert len(u) == n1 * n2 + 1 and sum(u) == comb(n, n1) and u == u[::-1]


def test_larger_samples_take_the_normal(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=40).round(1), rng.normal(0.4, 1, size=40).round(1)
    row = stats.mann_whitney(frame(spark, {"x": (a, b)}), ["family"]).first()
    assert row.method == "asymptotic" and 0 < row.p < 1


def test_shifts_are_the_median_of_all_differences(spark):
    rng = np.random.default_rng(5)
    pairs = dict(PAIRS)
    for k in range(12):  # wide, lumped and skewed samples, far more pairs than are listed
        scale = 10.0 ** rng.integers(-3, 4)
        pairs[f"random{k}"] = (rng.normal(size=rng.integers(1, 400)) * scale).round(4), (rng.exponential(size=rng.integers(1, 400)) ** 3 * scale).round(4)
    pairs["lumps"] = np.concatenate([rng.normal(size=200), 1000 + rng.normal(size=200)]), np.concatenate([rng.normal(size=150), 5000 + rng.normal(size=150)])
    pairs["counts"] = rng.integers(0, 30, 3000), rng.integers(0, 30, 2000)
    found = {r.family: r["shift"] for r in stats.shift(frame(spark, pairs), ["family"], pivots=7).collect()}
    assert found.keys() == pairs.keys()
    for name, (a, b) in pairs.items():
        assert found[name] == pytest.approx(np.median(np.subtract.outer(np.array(a), np.array(b))), rel=1e-9, abs=1e-9), name


def test_tests_of_empty_tables(spark):
    nothing = frame(spark, {}).where("false")
    assert stats.shift(nothing, ["family"]).count() == 0 and stats.mann_whitney(nothing, ["family"]).count() == 0


def test_reasons_and_the_untested_line(spark):
    rows = [("g0", 1.0), ("g0", 2.0), ("g1", 5.0), ("g1", 6.0), ("g2", 9.0)]
    planned = stats.plan(spark.createDataFrame(rows, "group string, value double"))
    reasons = {(r.group_a, r.group_b): r.reason for r in planned.collect()}
    assert reasons == {("g0", "g1"): None, ("g0", "g2"): "1 object in g2", ("g1", "g2"): "1 object in g2"}
    line = stats.untested_line(planned).first()
    assert line.line == "not tested: g2 (1 object)" and line.rungs == 2
    assert tuple(stats.untested_line(planned.where("reason is null")).first()) == (None, 1)
