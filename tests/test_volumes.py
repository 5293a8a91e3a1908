import numpy as np
import pytest

from granula.operators import volumes


def test_dilation_of_a_point(spark):
    df = spark.createDataFrame([("o", "e", 0, 0, 0)], "object_id string, entity string, z int, y int, x int")
    assert volumes.dilated(df, 2).count() == 125 and volumes.grown(np.pad(np.ones((1, 1, 1), bool), 3), 2).sum() == 125


def test_components_by_connectivity():
    m = np.eye(3, dtype=bool)[None]
    assert volumes.labelled(m).max() == 1 and volumes.labelled(m, full=False).max() == 3


def test_squared_distance():
    m = np.zeros((1, 5, 9), bool)
    m[0, 1:4, 1:4] = m[0, 1:4, 5:8] = m[0, 2, 4] = True
    d = volumes.squared_distance(m, (1.0, 2.0, 1.0))
    out = np.argwhere(~m)
    assert all(d[tuple(p)] == (((out - p) * [1.0, 2.0, 1.0]) ** 2).sum(axis=1).min() for p in np.argwhere(m)) and (d[~m] == 0).all()


def test_thinning_keeps_a_line():
    m = np.zeros((9, 20), bool)
    m[3:6, 2:18] = True
    t = volumes.thinned(m)
    assert t.sum() < 18 and (t & ~m).sum() == 0 and volumes.labelled(t).max() == 1


def test_outlines_have_the_hole():
    m = np.ones((5, 5), bool)
    m[2, 2] = False
    loops = volumes.outlines(m)
    area = [abs((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum()) / 2 for p in loops]
    assert sorted(area) == pytest.approx([0.5, 24.5])
