"""What becomes of masks in pieces, of declared labels and of what lies outside the object mask."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions.settings import RunConfig
from granula.operators import graph
from granula.process import run
from granula.sources import images

VOXEL = (0.1, 0.02, 0.02)


def frames(spark, shapes, kinds):
    rows = [("o", e, *map(int, p), int(m[tuple(p)])) for e, m in shapes.items() for p in np.argwhere(m)]
    return spark.createDataFrame(rows, "object_id string, entity string, z int, y int, x int, label long"), spark.createDataFrame([("o", e, *k) for e, k in kinds.items()], "object_id string, entity string, entity_kind string, declared boolean")


def pieces(n, value=1):
    m = np.zeros((1, 3, 12), int)
    for k in range(n):
        m[0, 1, 3 * k] = value
    return m


@pytest.mark.parametrize("auto", [False, True])
def test_promotion(spark, auto):
    ids = pieces(3)
    ids[0, 1, 3] = 7
    shapes = {"pm": pieces(4), "two": pieces(2, 5), "one": pieces(1), "plain": pieces(2), "said": pieces(2), "whole": pieces(1), "ids": ids}
    kinds = {"pm": ("mask", False), "two": ("mask", False), "one": ("mask", False), "plain": ("label", False), "said": ("label", True), "whole": ("label", True), "ids": ("label", True), "empty": ("label", True)}
    voxels, found = graph.promoted(*frames(spark, shapes, kinds), "pm", auto)
    kind = {r.entity: r.entity_kind for r in found.collect()}
    labels = {r.entity: sorted(r.ls) for r in voxels.groupBy("entity").agg(F.collect_set("label").alias("ls")).collect()}
    assert kind == {"pm": "mask", "two": "label" if auto else "mask", "one": "mask", "plain": "label", "said": "label", "whole": "label", "ids": "label", "empty": "label"}
    # a declared binary volume is always numbered, a plain one only when asked, and ids that are there stay
    assert labels == {"pm": [1], "two": [1, 2] if auto else [1], "one": [1], "plain": [1, 2] if auto else [1], "said": [1, 2], "whole": [1], "ids": [1, 7]}


def write(folder, **volumes):
    folder.mkdir(parents=True)
    for end, v in volumes.items():
        (folder / f"cell{'' if end == 'source' else '_' + end}.tif").write_bytes(images.write_tiff(v, VOXEL))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, shape = tmp_path_factory.mktemp("clip"), (12, 40, 40)
    mask, labels, nucleus = (np.zeros(shape, t) for t in (np.uint8, np.uint16, np.uint8))
    mask[2:10, 4:20, 4:20] = 1
    mask[3, 34, 18] = 1  # stretches the box past the second label
    labels[4:8, 8:14, 8:14], labels[4:8, 26:32, 8:14] = 1, 2
    nucleus[4:6, 6:8, 6:8] = nucleus[4:6, 15:17, 15:17] = 1
    write(root / "cell", source=np.zeros(shape, np.uint8) + 3, pm_mask=mask, mito_label=labels, nucleus_mask=nucleus)
    return str(root)


@pytest.mark.parametrize("clip,auto", [(True, False), (False, False), (True, True)])
def test_settings_reach_the_run(spark, folder, clip, auto):
    voxels, kinds, objects, failures = run.loaded(spark, folder, RunConfig.of(object_mask="pm", clip=clip, auto_label_masks=auto))
    assert failures.count() == 0 and objects.count() == 1
    assert {r.label for r in voxels.where("entity = 'mito'").collect()} == ({1} if clip else {1, 2})
    assert {r.label for r in voxels.where("entity = 'nucleus'").collect()} == ({1, 2} if auto else {1})
    assert {r.entity: r.entity_kind for r in kinds.collect()} == {"pm": "mask", "mito": "label", "nucleus": "label" if auto else "mask"}


def test_defaults_are_those_that_answers_depend_on():
    config = RunConfig()
    assert (config.clip, config.auto_label_masks, config.contact_um, config.max_skeleton_voxels, config.skeleton_prune, config.skeletons) == (True, False, 0.5, 500_000, 2.0, ())
    assert RunConfig.of(clip=False).fingerprint() != config.fingerprint()
