"""A folder of four synthetic objects from discovery to the report, and the commands around it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula import __main__ as commands
from granula.functions.settings import RunConfig
from granula.process import cells, measurers, run
from granula.sources import images, reports, stores

SHAPE, VOXEL = (20, 40, 40), (0.1, 0.02, 0.02)
OBJECTS = {"control/object_a": (4, (2, 3, 3)), "control/object_b": (4, (2, 2.5, 2.5)), "treated/object_c": (3, (3, 4.5, 4.5)), "treated/object_d": (3, (3, 5, 5))}


def ball(centre, radii, shape=SHAPE):
    grid = np.meshgrid(*map(np.arange, shape), indexing="ij")
    return sum(((g - c) / r) ** 2 for g, c, r in zip(grid, centre, radii, strict=True)) <= 1


def write_batch(root):
    for name, (n, radii) in OBJECTS.items():
        folder = root / name
        folder.mkdir(parents=True)
        pm, mito = ball((10, 20, 20), (9, 18, 18)), np.zeros(SHAPE, np.uint16)
        for i in range(n):
            mito[ball((10, 20 + 9 * np.sin(2 * np.pi * i / n), 20 + 9 * np.cos(2 * np.pi * i / n)), radii) & pm] = i + 1
        stem = name[-1] + "1"
        for end, v in {"": pm.astype(np.uint8) * 9, "_pm_mask": pm.astype(np.uint8), "_nucleus_mask": ball((10, 14, 14), (4, 6, 6)).astype(np.uint8), "_mito_label": mito}.items():
            (folder / f"{stem}{end}.tif").write_bytes(images.write_tiff(v, VOXEL))


@pytest.fixture(scope="module")
def measured(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    write_batch(root)
    (root / "broken").mkdir()
    (root / "broken" / "x.tif").write_bytes(b"II*\0")
    (root / "broken" / "x_pm_mask.tif").write_bytes(images.write_tiff(np.ones(SHAPE, np.uint8), VOXEL))
    config = RunConfig.of(object_mask="pm", histograms=True, skeletons=("mito",), contact_um=0.5, groups=("control", "treated"))
    out = str(root / "out.parquet")
    failures = run.process(spark, str(root), out, config, {"mito": "#d62728"}, project="demo")
    rows, footer = reports.read_report(spark, out)
    return root, rows.cache(), footer, failures.collect()


def test_row_counts(measured):
    _, rows, footer, failures = measured
    counts = {r.row_type: r["count"] for r in rows.groupBy("row_type").count().collect()}
    assert {k: counts[k] for k in ("object", "entity", "instance", "distance", "baseline")} == {"object": 4, "entity": 12, "instance": 14, "distance": 28, "baseline": 8}
    objects = {r.object_id: r for r in rows.where("row_type = 'object'").collect()}
    assert [objects[f"object_{k}"].instance_count for k in "abcd"] == [4, 4, 3, 3] and objects["object_a"].group == "control"
    assert footer["project"] == "demo" and [f.object_id for f in failures] == ["broken"]


def test_measures(measured):
    _, rows, _, _ = measured
    contact = rows.where("row_type = 'contact'")
    assert contact.where("contact_entity <> 'mito' or contact_gap_um > 0.5").isEmpty()
    per = {r.object_id: r.n for r in contact.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.object_id: r.contact_count for r in rows.where("row_type = 'object'").collect()} == {f"object_{k}": per.get(f"object_{k}", 0) for k in "abcd"}
    volume = sum(1 for _ in np.argwhere(ball((10, 20, 20), (9, 18, 18)))) * 4e-5
    assert rows.where("row_type = 'object'").first().object_volume_um3 == pytest.approx(volume, rel=1e-5)
    mean = {r.group: r.v for r in rows.where("row_type = 'instance'").join(rows.where("row_type = 'object'").select("object_id", F.col("group").alias("g")), "object_id").groupBy(F.col("g").alias("group")).agg(F.avg("instance_volume_um3").alias("v")).collect()}
    assert mean["treated"] > mean["control"]
    base = rows.where("row_type = 'baseline'").collect()
    assert {r.baseline_target for r in base} == {"nucleus", "pm"} and all(len(json.loads(r.baseline_hist_counts)) == 128 and sum(json.loads(r.baseline_hist_counts)) == r.baseline_voxels for r in base)
    assert rows.where("row_type = 'instance' and instance_length_um is null").isEmpty()
    assert {r.entity_colour for r in rows.where("row_type = 'entity'").collect()} == {"#d62728", None}


def test_commands(measured, capsys, tmp_path):
    root = measured[0]
    assert commands.main(["dry-run", str(root), "--object-mask", "pm"]) == 1  # the broken folder
    said = capsys.readouterr()
    assert "label:mito in 4 objects" in said.out and "x.tif" in said.err
    assert commands.main(["describe", str(root / "out.parquet"), "four cells"]) == 0 and reports.read_footer(str(root / "out.parquet"))["description"] == "four cells"
    (tmp_path / "p.json").write_text('{"pm": "#abc"}')
    assert commands.main(["colours", str(root / "out.parquet"), str(tmp_path / "p.json")]) == 0 and "4 rows" in capsys.readouterr().out
    assert commands.main(["mesh", str(root / "control"), "-o", str(tmp_path / "geo"), "--object-mask", "pm"]) == 0


def test_geometry_of_the_mesh_command(spark, measured, tmp_path):
    commands.main(["mesh", str(measured[0] / "treated"), "-o", str(tmp_path / "geo"), "--object-mask", "pm", "--contact-um", "0.5"])
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{tmp_path}/geo/0.1x0.02x0.02")
    counts = {r.row_type: r["count"] for r in rows.groupBy("row_type").count().collect()}
    assert counts["instance"] == 6 and counts["file"] == 4 and rows.where("row_type <> 'contact' and surface is null").isEmpty()


def test_registry():
    assert [m.NAME for m in measurers.chosen(("contacts",))] == ["morphology", "instances"]
    with pytest.raises(ValueError, match="nothing"):
        measurers.chosen(("nothing",))
    assert RunConfig.of(noun="cell").fingerprint() != RunConfig().fingerprint()


def test_touching_cells_are_cut(spark, tmp_path, capsys):
    shape = (24, 30, 60)
    membrane, seeds = np.zeros(shape, bool), np.zeros(shape, np.uint16)
    for k, x in ((2, 18), (1, 41)):
        whole = ball((12, 15, x), (10, 10, 10), shape)
        membrane |= whole & ~ball((12, 15, x), (9, 9, 9), shape)
        seeds[ball((12, 15, x), (4 - k % 2, 4, 4), shape)] = k
    for name, v in (("membrane", membrane), ("seeds", seeds)):
        (tmp_path / f"{name}.tif").write_bytes(images.write_tiff(v.astype(np.uint16), (1.0, 1.0, 1.0)))
    out = tmp_path / "cells"
    call = ["cells", "--membrane", str(tmp_path / "membrane.tif"), "--seeds", str(tmp_path / "seeds.tif"), "--voxel-size", "1,1,1", "--output", str(out), "--walls", "1", "--least-um3", "20"]
    assert commands.main(call) == 0
    assert capsys.readouterr().out.split() == [f"{out}/cell_0001", f"{out}/cell_0002"]
    said = [json.loads((out / f"cell_{k:04d}" / "source.json").read_text()) for k in (1, 2)]
    assert said[0]["object_mask"] == "cell" and said[0]["derived"]["touches"] == "" and said[0]["derived"]["walls"] == 1
    masks = [images.read_volume("m.tif", (out / f"cell_{k:04d}" / "cell_mask.tif").read_bytes()) for k in (1, 2)]
    boxes = [[tuple(map(int, p.split(":"))) for p in s["crop"].split(",")] for s in said]
    whole = np.zeros(shape, int)
    for k, (m, box) in enumerate(zip(masks, boxes, strict=True), 1):
        assert m.shape == tuple(b - a for a, b in box)
        whole[tuple(slice(*b) for b in box)] += k * (m > 0)
    assert set(np.unique(whole)) == {0, 1, 2} and whole[12, 15, 18] == 1  # the larger seed is the first
    assert (whole[ball((12, 15, 41), (7, 7, 7), shape)] == 2).all() and whole[0, 0, 0] == 0
    with pytest.raises(ValueError, match="differ in shape"):
        (tmp_path / "small.tif").write_bytes(images.write_tiff(np.ones((2, 3, 4), np.uint16), (1.0, 1.0, 1.0)))
        cells.read(spark, {"membrane": str(tmp_path / "membrane.tif"), "seed": str(tmp_path / "small.tif"), "outside": None})


def test_chunked_stores(spark, tmp_path):
    v = np.zeros((5, 7, 9), np.uint16)
    v[1, 2:5, 3], v[4, 6, 8] = 5, 9
    zarr = tmp_path / "z"
    zarr.mkdir()
    (zarr / ".zarray").write_text(json.dumps({"shape": v.shape, "chunks": [2, 4, 4], "dtype": "<u2", "compressor": None, "order": "C", "fill_value": 0, "filters": None}))
    for z, y, x in np.ndindex(3, 2, 3):
        part = np.zeros((2, 4, 4), np.uint16)
        own = v[2 * z : 2 * z + 2, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
        part[tuple(map(slice, own.shape))] = own
        if part.any():
            (zarr / f"{z}.{y}.{x}").write_bytes(part.tobytes())
    (zarr / ".zattrs").write_text(json.dumps({"pixelResolution": {"dimensions": [4, 5, 6], "unit": "nm"}}))
    want = sorted((int(z), int(y), int(x), int(v[z, y, x])) for z, y, x in np.argwhere(v))
    assert sorted(map(tuple, stores.voxels(spark, str(zarr)).collect())) == want
    assert sorted(map(tuple, stores.voxels(spark, str(zarr), [(1, 3), (None, None), (2, 9)]).collect())) == [(0, y, 1, 5) for y in (2, 3, 4)]
    assert stores.voxel_size_um(str(tmp_path), "z") == (0.006, 0.005, 0.004)
