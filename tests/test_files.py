import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.operators import branches, geometry, skeleton
from granula.sources import images, reports


def volume():
    v = np.zeros((3, 5, 4), np.uint16)
    v[1, 2:4, 1:3], v[2, 0, 0] = 7, 300
    return v


def nifti(v, size):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *v.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 512, 16)
    struct.pack_into("<8f", head, 76, 1, *size[::-1], 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352)
    return bytes(head) + v.tobytes()


def test_readers(spark, tmp_path):
    v = volume()
    (tmp_path / "a.tif").write_bytes(images.write_tiff(v, (0.5, 0.25, 0.125)))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti(v, (0.001, 0.002, 0.004))))
    (tmp_path / "c.nrrd").write_bytes(b"NRRD0004\ntype: ushort\ndimension: 3\nsizes: 4 5 3\nspacings: 0.1 0.2 0.3\nencoding: raw\nendian: little\n\n" + v.tobytes())
    (tmp_path / "d.tif").write_bytes(b"broken")
    files = images.image_files(spark, str(tmp_path))
    heads = {r.path.rsplit("/", 1)[1]: r for r in images.headers(files).collect()}
    assert heads["a.tif"].spacing_um == pytest.approx([0.5, 0.25, 0.125]) and heads["a.tif"].dtype == "u2"
    assert heads["b.nii.gz"].spacing_um == pytest.approx([1, 2, 4], rel=1e-5) and heads["c.nrrd"].spacing_um == pytest.approx([300, 200, 100])
    assert heads["d.tif"].error and all(heads[n].shape == [3, 5, 4] for n in ("a.tif", "b.nii.gz", "c.nrrd"))
    want = sorted((int(z), int(y), int(x), int(v[z, y, x])) for z, y, x in np.argwhere(v))
    for name in ("a.tif", "b.nii.gz", "c.nrrd"):
        assert sorted((r.z, r.y, r.x, r.label) for r in images.sparse_voxels(files.where(F.col("name") == name)).collect()) == want


def test_report_round_trip(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") / 3).alias("size"))
    path = reports.write_report(df, str(tmp_path / "r"), {"size": "size of the object"}, noun="cell", project="demo")
    rows, footer = reports.read_report(spark, path)
    assert rows.count() == 5 and dict(rows.dtypes)["size"] == "float" and footer["project"] == "demo" and "size of the cell" in footer["columns"]
    reports.describe(path, "about it")
    assert reports.read_footer(path)["description"] == "about it" and spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="empty"):
        reports.write_report(df.where("false"), str(tmp_path / "e"))


def test_payloads():
    v = np.array([[0.0, 1, 2], [3, 4, 5], [1, 1, 9]])
    back, i = geometry.decode_mesh(geometry.encode_mesh(v, np.array([[0, 1, 2]])))
    assert back == pytest.approx(v, abs=1e-3) and i.tolist() == [0, 1, 2]
    both = geometry.decode_mesh(geometry.merged([geometry.encode_mesh(v, np.array([0, 1, 2]))] * 2))
    assert both[1].tolist() == [0, 1, 2, 3, 4, 5] and geometry.header_counts(b"123") == (None, None)
    with pytest.raises(ValueError, match="length"):
        geometry.decode_mesh(geometry.encode_mesh(v, np.array([0, 1, 2])) + b"x")
    assert len(geometry.encode_ellipsoid(np.zeros(3), np.ones(3), np.eye(3))) == 60


def test_surface_net_is_closed_and_wound_outwards():
    z, y, x = np.ogrid[-9:10, -9:10, -9:10]
    vertices, faces = geometry.surface_net(z * z + y * y + x * x <= 49)
    vertices = vertices[:, ::-1]  # as it is stored: x, y, z
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    volume = np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6
    edges = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] % 2 == 0).all()
    assert volume == pytest.approx(4 / 3 * np.pi * 343, rel=0.08)


def test_skeleton_measures(spark):
    line = np.array([[0.0, 0, k] for k in range(5)])
    edges = np.array([[0, 1], [1, 2], [2, 3], [3, 4]])
    assert skeleton.graph_metrics(line, edges) == (1, 4.0, pytest.approx(1.0)) and skeleton.tips(5, edges) == [0, 4]
    fork = np.vstack([line, [[0.0, 0.4, 2]]])
    forked = np.vstack([edges, [[2, 5]]])
    assert skeleton.graph_metrics(fork, forked)[0] == 3
    assert len(skeleton.pruned(fork, forked, np.full(6, 1.0))) == 4 and len(skeleton.pruned(fork, forked, np.full(6, 0.1))) == 5
    assert skeleton.graph_metrics(np.zeros((0, 3)), np.zeros((0, 2), int)) == (0, 0.0, None)
    ring = np.array([[0, 1], [1, 2], [2, 0]])
    assert len(skeleton.chains(3, ring)) == 1 and skeleton.tips(3, ring) == []
    v = spark.createDataFrame([("o", "e", 1, k, *map(float, p)) for k, p in enumerate(line)], "object_id string, entity string, label int, v int, z double, y double, x double")
    e = spark.createDataFrame([("o", "e", 1, *map(int, p)) for p in edges], "object_id string, entity string, label int, a int, b int")
    assert tuple(branches.metrics(e, v).first())[3:] == (1, 4.0, pytest.approx(1.0))
