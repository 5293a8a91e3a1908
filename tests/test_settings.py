"""Names, column families and labels that readers of reports use."""

import pytest

from granula.functions import settings
from granula.sources import reports


def test_geometry_kinds():
    assert settings.parse_geometry(["mito=mesh+tube", "er=skeleton", "pm=auto"]) == {"mito": ("mesh", "tube", "skeleton"), "er": ("skeleton",), "pm": ("auto",)}
    for wrong in ("mito", "=mesh", "mito=", "mito=cube"):
        with pytest.raises(ValueError, match="NAME=KIND"):
            settings.parse_geometry([wrong])
    with pytest.raises(ValueError, match="more than one surface"):
        settings.parse_geometry(["mito=mesh+ellipsoid"])


def test_only_reports_are_read(spark, tmp_path):
    settings.readable(["obs_level", "row_type", "object_id", "x"])
    for columns, why in (([], "no columns"), (["obs_level", "object_id"], "older form"), (["a"], "lacks obs_level, row_type, object_id"), (["obs_level", "row_type"], "lacks object_id")):
        with pytest.raises(ValueError, match=why):
            settings.readable(columns)
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    file = next((tmp_path / "x.parquet").glob("part-*.parquet"))
    with pytest.raises(ValueError, match="no report"):
        reports.read_report(spark, str(file), strict=True)


def test_column_families_share_nothing():
    columns = ["object_id", "volume_um3", "sphericity", "branches", "distance_to_pm_um", "distance_to_nucleus_um", "distance_to_nucleus_mean_um", "distance_to_mito_end_um", "polar_az_deg"]
    assert settings.distance_columns(columns, "pm", "mito") == ["distance_to_pm_um", "distance_to_nucleus_mean_um", "distance_to_mito_end_um"]
    shape = settings.shape_columns(columns)
    assert shape == ["volume_um3", "sphericity", "branches", "polar_az_deg"] and not set(shape) & set(settings.distance_columns(columns))
    assert settings.metric_names(3, ["pm"], True, True) == ["volume_um3", "surface_area_um2", "sphericity", "aspect_ratio_major_minor", "branches", "length_um", "tortuosity", "distance_to_pm_um", "distance_to_pm_mean_um", "distance_to_pm_end_um"]
    assert settings.metric_names(2, [])[:3] == ["area_um2", "perimeter_um", "circularity"]


def test_words():
    assert settings.label_of("distance_to_nucleus_um") == "Distance to nucleus (µm)" and settings.label_of("volume_um3") == "Volume (µm³)" and settings.label_of("n") == "N"
    assert settings.extent_terms(2)["unit"] == "µm²" and settings.extent_terms(3)["boundary"] == "surface area"
    assert (settings.noun_of(None, True), settings.noun_of(None, False), settings.noun_of("cell", False)) == ("object", "dataset", "cell")
    assert settings.with_article("object") == "an object" and settings.with_article("cell/cells") == "a cell"


def test_masks_and_keys():
    entities = [("pm", "mask"), ("mito", "label"), ("nucleus", "mask")]
    assert settings.bounding_mask(entities, "pm") == "pm" and settings.bounding_mask(entities, None) is None and settings.bounding_mask(entities[:2], "x") == "pm"
    assert settings.key_by_name(entities, "mito") == ("mito", "label") and settings.key_by_name(entities, "er") is None


def test_facets():
    assert settings.facet_by(2) == "group" and settings.facet_by(1) == "object"
    assert settings.facet_labels(["run_a_x", "run_b_x", "run_cc_x"]) == ["a", "b", "cc"]
    assert settings.facet_labels(["same"]) == ["same"] and settings.facet_labels(["ab", "abc"]) == ["ab", "abc"] and settings.facet_labels([]) == []


def test_help_by_name_pattern_and_prefix():
    exact, patterns = {"volume_um3": "size", "instance_branches": "branches"}, [(r"distance_to_.+_um", "distance")]
    assert settings.metric_help("instance_volume_um3", exact, patterns) == "size" and settings.metric_help("branches", exact, patterns) == "branches"
    assert settings.metric_help("distance_to_pm_um", exact, patterns) == "distance" and settings.metric_help("x", exact, patterns) is None
