"""Neighbourhood kernels that work on many bricks at once."""

from itertools import product

import numpy as np
import pyarrow as pa

from granula.operators import bricks
from granula.operators.graph import neighbour_offsets


def test_intercepts_over_many_bricks_against_plain_counts(spark):
    rng = np.random.default_rng(4)
    places = {(f"o{o}", "a", z, y, x): int(rng.integers(1, 4)) for o in range(6) for z, y, x in product(range(-3, 5), repeat=3) if rng.random() < 0.5}
    places |= {("far", "a", 50 * k, -40 * k, 7): 1 for k in range(4)} | {(None, "a", 0, 0, k): 2 for k in range(9)} | {("o1", "b", 0, 0, 3): 1}
    df = spark.createDataFrame([(*k, v) for k, v in places.items()], "object_id string, entity string, z int, y int, x int, label int")
    offsets, want = neighbour_offsets(3), {}
    for (o, e, *at), v in places.items():
        row = want.setdefault((o, e, v), [0] * 27)
        row[0] += 1
        for k, d in enumerate(offsets):
            row[k + 1] += places.get((o, e, *(a + b for a, b in zip(at, d, strict=True)))) != v
    got = bricks.intercepts(df, offsets, ["object_id", "entity"], side=4, rows=100, cells=500).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want and len(got) == len(want)


def test_a_task_works_on_many_small_bricks_at_once():
    rows = pa.table({"k": np.repeat(np.arange(1000), 7), "bz": np.repeat(np.arange(1000) % 3, 7)})
    found = list(bricks.whole_bricks(rows.to_batches(10), ["k", "bz"], 500))
    assert sum(len(h) for _, h in found) == 1000 and len(found) < 20
    assert pa.concat_tables([t for t, _ in found]).equals(rows) and all((np.diff(h) == 7).all() and h[0] == 0 for _, h in found)
    long = pa.table({"k": [1] * 3000 + [2] * 5, "bz": [0] * 3005})
    found = list(bricks.whole_bricks(long.to_batches(10), ["k", "bz"], 500))
    assert pa.concat_tables([t for t, _ in found]).equals(long) and [t["k"][int(k)].as_py() for t, h in found for k in h] == [1, 2]
    assert list(bricks.whole_bricks([], ["k"])) == []
