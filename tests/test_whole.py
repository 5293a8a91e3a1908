"""Queries without SQL cover all rows of their tables: brute force in Python."""

import math
from collections import Counter
from itertools import combinations
from statistics import median

import pytest
from conftest import SF

from granula.plans import registry


def test_rank_test_covers_every_object(spark):
    found = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type", "user_id", "round(value, 2) AS value").collect():
        found.setdefault(r.event_type, {}).setdefault(r.user_id, []).append(r.value)
    values = {g: [round(median(v), 3) for v in users.values()] for g, users in found.items()}
    got = {(r.group_a, r.group_b): r for r in registry.queries()["mann_whitney_p"](spark, SF).collect()}
    assert set(got) == set(combinations(sorted(values), 2))
    for (a, b), r in got.items():
        x, y = values[a], values[b]
        n = len(x) + len(y)
        u = sum((p > q) + (p == q) / 2 for p in x for q in y)
        assert (r.n_a, r.n_b, r.u) == (len(x), len(y), u)
        ties = sum(k**3 - k for k in Counter(x + y).values())
        spread = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
        assert n > 20 and r.p == pytest.approx(min(1.0, math.erfc(max(0.0, abs(u - len(x) * len(y) / 2) - 0.5) / spread / math.sqrt(2))), abs=1e-6)
