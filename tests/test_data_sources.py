"""Chunks as partitions with a pushed box, and reports that commit or leave nothing."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granula.sources import chunk_source, report_sink

CHUNKS, SHAPE = (4, 8, 8), (10, 20, 30)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Samples from the rows of a table, a file for each chunk that has one; those outside z < 4, y < 8 cannot be read."""
    root = tmp_path_factory.mktemp("store")
    v = np.zeros(SHAPE, np.uint16)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").collect():
        v[r.l_orderkey % SHAPE[0], r.l_partkey % SHAPE[1], r.l_suppkey * 7 % SHAPE[2]] = r.l_linenumber
    v[:4, 8:16, :8] = 0  # one chunk is never written
    (root / ".zarray").write_text(json.dumps({"shape": SHAPE, "chunks": CHUNKS, "dtype": "<u2", "compressor": None, "order": "C", "fill_value": 0, "filters": None}))
    poisoned = root.parent / "poisoned"
    poisoned.mkdir()
    (poisoned / ".zarray").write_text((root / ".zarray").read_text())
    for place in np.ndindex(*(-(-n // c) for n, c in zip(SHAPE, CHUNKS, strict=True))):
        part = np.zeros(CHUNKS, np.uint16)
        own = v[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, CHUNKS, strict=True))]
        part[tuple(map(slice, own.shape))] = own
        if part.any():
            name = ".".join(map(str, place))
            (root / name).write_bytes(part.tobytes())
            (poisoned / name).write_bytes(part.tobytes() if place[:2] == (0, 0) else b"broken")
    chunk_source.register(spark)
    return v, str(root), str(poisoned)


def rows(v, box=None):
    box = box or [(0, n) for n in v.shape]
    own = v[tuple(slice(*b) for b in box)]
    return sorted((*map(int, p), int(own[tuple(p)])) for p in np.argwhere(own))


def test_all_chunks_and_boxes(spark, store):
    v, root, _ = store
    read = lambda **options: spark.read.format("voxel_chunks").options(**options)
    assert sorted(map(tuple, read().load(root).collect())) == rows(v)
    assert sorted(map(tuple, read(box="2:9,:,5:17").load(root).collect())) == rows(v, [(2, 9), (0, 20), (5, 17)])
    assert read(box="9:9,:,:").load(root).count() == 0
    assert read().load(root).where("label > 3 and z >= 8").count() == sum(r[3] > 3 and r[0] >= 8 for r in rows(v))


def test_chunks_outside_are_not_opened(spark, store):
    v, _, poisoned = store
    read = spark.read.format("voxel_chunks")
    by_option = read.option("box", "0:4,0:8,:").load(poisoned)
    assert sorted(map(tuple, by_option.collect())) == rows(v, [(0, 4), (0, 8), (0, 30)]) and by_option.rdd.getNumPartitions() == 4
    pushed = spark.read.format("voxel_chunks").load(poisoned).where("z < 4 and y <= 7 and x > 10 and x < 15")
    assert sorted(map(tuple, pushed.collect())) == [r for r in rows(v, [(0, 4), (0, 8), (0, 30)]) if 10 < r[2] < 15] and pushed.rdd.getNumPartitions() == 1
    shifted = spark.read.format("voxel_chunks").option("box", "1:10,2:20,3:30").load(poisoned).where("z = 2 and y = 4 and label is not null")
    assert sorted(map(tuple, shifted.collect())) == [(2, 4, r[2] - 3, r[3]) for r in rows(v) if r[0] == 3 and r[1] == 6 and r[2] >= 3]
    with pytest.raises(PySparkException):
        spark.read.format("voxel_chunks").load(poisoned).collect()


def test_errors_of_the_source(spark, store, tmp_path):
    with pytest.raises(PySparkException, match="neither a Zarr nor an N5"):
        spark.read.format("voxel_chunks").load(str(tmp_path)).collect()
    with pytest.raises(PySparkException, match="no box of 3"):
        spark.read.format("voxel_chunks").option("box", "1:2").load(store[1]).collect()


def files(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_report_is_written_by_its_tasks(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").repartition(5)
    out = tmp_path / "report"
    report_sink.write_report(df, str(out), {"o_totalprice": "price of the object"}, "cell", project="demo")
    assert len([f for f in files(out) if f.startswith("part-")]) == 5 and "_SUCCESS" in files(out) and not (out / "_temporary").exists()
    for p in out.glob("part-*"):
        schema = pq.read_schema(p)
        assert schema.metadata[b"granula.project"] == b"demo" and schema.field("o_totalprice").metadata[b"description"] == b"price of the cell" and str(schema.field("o_totalprice").type) == "float"
    assert report_sink.read_footer(str(out))["project"] == "demo"
    back = spark.read.parquet(str(out))
    assert back.count() == df.count() and back.agg(F.sum("o_orderkey")).first() == df.agg(F.sum("o_orderkey")).first()
    report_sink.write_report(df.where("o_orderkey < 100").coalesce(1), str(out), project="again")
    assert len([f for f in files(out) if f.startswith("part-")]) == 1 and report_sink.read_footer(str(out))["project"] == "again"
    df.where("o_orderkey >= 100").coalesce(1).write.format("granula_report").mode("append").save(str(out))
    assert spark.read.parquet(str(out)).count() == df.count()


def test_a_failed_report_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "report"
    good = spark.range(100).withColumn("v", F.col("id") * 1.0)
    report_sink.write_report(good, str(out), project="first")
    before = files(out)
    with pytest.raises(PySparkException):
        report_sink.write_report(spark.range(0, 1000, 1, 4).withColumn("v", F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.lit("x"))), str(out))
    assert files(out) == before and spark.read.parquet(str(out)).count() == 100
    with pytest.raises(PySparkException, match="the report is empty"):
        report_sink.write_report(good.where("false"), str(out))
    assert files(out) == before
    with pytest.raises(PySparkException):
        report_sink.write_report(good.where("false"), str(tmp_path / "new"))
    assert not (tmp_path / "new").exists() or files(tmp_path / "new") == []
