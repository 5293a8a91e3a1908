"""Measures by name in SQL against the DataFrame form."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granula.operators import morphology
from granula.process import sql

SPACING = (0.5, 0.2, 0.1)


@pytest.fixture(scope="module")
def voxels(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(f"o{rng.integers(3)}", str(rng.choice(["a", "b"])), *map(int, rng.integers(0, 9, 3)), int(rng.integers(1, 4))) for _ in range(4000)})
    df = spark.createDataFrame(rows, "object_id string, entity string, z int, y int, x int, label int")
    df.createOrReplaceTempView("some_voxels")
    return df


def call(spark, name, table="some_voxels", function="measure"):
    return spark.sql(f"SELECT * FROM {function}(TABLE({table}) PARTITION BY (object_id), '{name}')")


def test_morphology_is_the_frame_form(spark, voxels):
    sql.register(spark, SPACING)
    got = {(r.object_id, r.entity, r.label): r for r in call(spark, "morphology").groupBy("object_id", "entity", "label").pivot("metric").agg(F.first("value")).collect()}
    want = morphology.instance_sizes(voxels, SPACING).join(morphology.centroids(voxels, SPACING), ["object_id", "entity", "label"]).collect()
    assert len(got) == len(want)
    for r in want:
        own = got[r.object_id, r.entity, r.label]
        assert [own[c] for c in ("volume_um3", "z_um", "y_um", "x_um")] == pytest.approx([r[c] for c in ("volume_um3", "z_um", "y_um", "x_um")])
    boxes = call(spark, "boxes").groupBy("object_id", "entity", "label").pivot("metric").agg(F.first("value")).collect()
    want = {(r.object_id, r.entity, r.label): r for r in morphology.bounding_boxes(voxels).collect()}
    assert len(boxes) == len(want) and all(r[c] == pytest.approx(want[r.object_id, r.entity, r.label][c]) for r in boxes for c in ("min_z", "max_z", "min_y", "max_x", "fill_ratio"))


def test_own_measures_names_and_empty_tables(spark, voxels):
    class Count(sql.Sums):
        FIELDS = ("n",)

        def add(self, entity, label, at):
            own = self.places(entity, label)
            np.add.at(self.held["n"], own, 1)

        def rows(self):
            yield from ((e, k, "voxels", float(self.held["n"][i])) for i, (e, k) in enumerate(self.names))

    sql.register(spark, SPACING, {"voxels": Count}, "counted")
    assert call(spark, "voxels", function="counted").agg(F.sum("value")).first()[0] == voxels.count()
    voxels.where("false").createOrReplaceTempView("no_voxels")
    assert call(spark, "voxels", "no_voxels", "counted").count() == 0
    with pytest.raises(PySparkException, match="no measure is called"):
        call(spark, "volume", function="counted").collect()


def test_packed_voxels_and_several_names_in_one_pass(spark, voxels):
    sql.register(spark, SPACING)
    more = voxels.union(voxels.limit(20)).union(spark.createDataFrame([(None, "a", -3, 8, 70, 2), ("o1", None, 0, 0, 0, 5)], voxels.schema))  # repeated voxels each count
    more.createOrReplaceTempView("more_voxels")
    rows = sql.packed(more).localCheckpoint()
    rows.createOrReplaceTempView("packed_voxels")
    assert rows.count() < more.count() / 4 and rows.selectExpr("max(size(z))").first()[0] <= sql.PACK**3 * 2
    found = lambda df: sorted((str(r.object_id), r.entity, r.label, r.metric, round(r.value, 9)) for r in df.collect())
    plain = found(call(spark, "morphology", "more_voxels").union(call(spark, "boxes", "more_voxels")))
    assert found(call(spark, "morphology, boxes", "packed_voxels")) == plain and found(call(spark, "boxes,morphology", "more_voxels")) == plain
