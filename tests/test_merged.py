"""Payloads of whole structures against those put together in one place."""

import hashlib

import numpy as np
import pytest

from granula.operators import geometry, merged


def mesh(rng, n, m):
    return geometry.encode_mesh(rng.normal(size=(n, 3)) * 10 ** rng.uniform(-2, 2) + rng.normal(size=3) * 50, rng.integers(0, n, (m, 3)))


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(6)
    rows = [(f"o{k % 3}", "ab"[k % 2], k, mesh(rng, int(rng.integers(3, 60)), int(rng.integers(1, 90)))) for k in range(40)]
    rows += [("big", "a", k, mesh(rng, 9000, 400)) for k in range(8)]  # past 65,535 vertices
    return [*rows, ("o0", "a", 100, None), ("o0", "a", 101, b""), ("none", "a", 1, None)]


def test_payloads_are_those_of_one_place(spark, scene):
    df = spark.createDataFrame([(*r, "x") for r in scene], "object_id string, entity_name string, label int, surface binary, n string").repartition(7)
    parts = merged.scene_parts(df)
    found = {(r.object_id, r.entity_name): bytes(r.surface) for r in merged.scene_payloads(parts).collect()}
    want = {}
    for o, e, _, data in sorted((r for r in scene if r[3]), key=lambda r: r[2]):
        want.setdefault((o, e), []).append(data)
    assert found.keys() == want.keys()
    for key, pieces in want.items():
        whole = geometry.merged(pieces)
        assert hashlib.sha256(found[key]).hexdigest() == hashlib.sha256(whole).hexdigest()
        vertices, indices = geometry.decode_mesh(found[key])
        assert geometry.header_counts(found[key]) == (sum(geometry.header_counts(p)[0] for p in pieces), sum(geometry.header_counts(p)[1] for p in pieces))
        assert indices.max() < len(vertices)
    n, m = geometry.header_counts(found["big", "a"])
    assert n == 72_000 and len(found["big", "a"]) == 32 + 6 * n + 4 * m
    # parts lie side by side
    for key, data in found.items():
        own = sorted((r.offset, len(r.bytes)) for r in parts.where(f"object_id = '{key[0]}' and entity_name = '{key[1]}'").collect())
        assert own[0] == (0, 32) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == len(data)


def test_large_payloads_stay_in_parts(spark, scene):
    df = spark.createDataFrame([r for r in scene if r[0] in ("big", "o1")], "object_id string, entity_name string, label int, surface binary")
    found = {r.object_id: r for r in merged.scene_payloads(merged.scene_parts(df), most=100_000).where("entity_name = 'a'").collect()}
    assert found["big"].surface is None and found["big"].n_bytes > 100_000 and found["o1"].surface is not None
    assert merged.scene_parts(df.where("false")).count() == 0
