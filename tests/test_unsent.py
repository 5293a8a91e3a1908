"""Sides of joins that grow with the input are never sent whole: Spark guesses the size of generated rows far too small."""

import pytest
from conftest import SF

from granula.operators import distance
from granula.plans import registry


@pytest.mark.parametrize("name", ["clip_to_mask", "distance_min", "distance_transform", "baseline_stats", "baseline_histogram", "tip_distance", "polar_depth", "geometry_rows", "flagship", "extent_gap"])
def test_no_side_of_a_join_of_voxels_is_broadcast(name, spark, monkeypatch):
    monkeypatch.setattr(distance, "stored", lambda df, name: df)  # the field's own joins stay in the plan
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    assert "Broadcast" not in plan
