import json

from pyspark.sql import functions as F

from granula.sources import discovery
from granula.streaming import resume


def test_discovery(spark):
    names = ["b/o1/cell.tif", "b/o1/cell_pm_mask.tif", "b/o1/cell_mito_label.tif", "b/o1/cell_mito_labels.tif", "b/o1/masks/nucleus.nii.gz", "b/o1/notes.txt", "b/o2/x_mask.tif"]
    df = spark.createDataFrame([(f"/{n}", 10) for n in names], "path string, length long")
    got = {r.path.rsplit("/", 1)[1]: (r.role, r.entity_name, r.entity_kind, r.reason) for r in discovery.discovered(df).collect()}
    assert got["cell.tif"][0] == "source" and got["cell_pm_mask.tif"] == ("entity", "pm", "mask", None)
    assert got["cell_mito_label.tif"][:3] == ("entity", "mito", "label") and got["cell_mito_labels.tif"][3] == "same name twice"
    assert got["nucleus.nii.gz"][:3] == ("entity", "nucleus", "auto") and got["x_mask.tif"][3] == "no source image"
    assert [r.object_dir for r in discovery.object_dirs(discovery.discovered(df)).collect()] == ["/b/o1"]
    assert discovery.crop_box("1:3,:,2:") == [(1, 3), (None, None), (2, None)] and discovery.crop_box(None) is None


def test_resume(spark, tmp_path):
    source, parts, state = (str(tmp_path / n) for n in ("in", "parts", "state"))
    (tmp_path / "in").mkdir()
    run = lambda: resume.run_available(spark, source, "object_key string, fingerprint string", lambda b: b.withColumn("size", F.lit(1)), parts, state)
    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"object_key": x, "fingerprint": "f"}) for x in keys))
        run()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(parts).collect()
    assert sorted(r.object_key for r in rows) == ["a", "b", "c"]
