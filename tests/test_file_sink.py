"""The sink of files: one file per row, nothing of tasks that failed."""

import pytest
from pyspark.sql import functions as F

from pavestat.sources import file_sink, readers, writers


def listed(path):
    return {p.name: p.read_bytes() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_committed_by_task(spark, tmp_path):
    df = spark.range(0, 50, 1, 6).select(F.concat("id", F.lit(".bin")).alias("name"), F.when(F.col("id") % 7 > 0, F.encode(F.col("id").cast("string"), "utf-8")).alias("content"))
    out = tmp_path / "files"
    file_sink.write_files(df, str(out), "name", "content")
    want = {f"{k}.bin": str(k).encode() if k % 7 else b"" for k in range(50)}
    assert listed(out) == want and len(list(out.glob("part-*"))) == 6 and not list(out.glob("_temporary*"))
    file_sink.write_files(df.limit(3).withColumn("name", F.concat(F.lit("more-"), "name")), str(out), "name", "content")
    assert len(listed(out)) == 53
    file_sink.write_files(df.where("name = '9.bin'"), f"file://{out}", "name", "content", "overwrite")
    assert listed(out) == {"9.bin": b"9"}
    file_sink.write_files(df.limit(0), str(tmp_path / "none"), "name", "content")


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "files"
    good = spark.createDataFrame([("a", b"1")], "name string, content binary")
    file_sink.write_files(good, str(out), "name", "content")
    for bad in ("x/y", "", None, ".hidden", "_temporary"):
        rows = spark.createDataFrame([(f"n{k}", b"2") for k in range(20)] + [(bad, b"3")], "name string, content binary").repartition(4)
        with pytest.raises(Exception, match="no name of a file"):
            file_sink.write_files(rows, str(out), "name", "content", "overwrite")
        assert listed(out) == {"a": b"1"} and not list(out.glob("_temporary*"))


def test_masks_beside_a_manifest(spark, tmp_path):
    rows = [("a b", b"1"), ("c/d é", b"2"), ("e", None), (None, b"3")]
    df = spark.createDataFrame(rows, "sample_id string, mask binary")
    paths = file_sink.write_masks(df, str(tmp_path / "masks"))
    got = dict(map(tuple, paths.collect()))
    assert got.keys() == {"a b", "c/d é"}
    samples = df.join(paths, "sample_id").select("sample_id", F.lit(4).alias("width"), F.struct("mask_path", F.lit("mask").alias("natural_gt")).alias("ground_truth"))
    writers.write_ground_truth(samples, str(tmp_path / "m"), "d", most=1)
    back = readers.manifest(spark, str(tmp_path / "m"), ("natural_gt",)).collect()
    assert [(r.position, r.sample_id, r.mask_path, r.natural_gt) for r in back] == [(0, "a b", got["a b"], "mask")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "masks"))
    assert {r.path: bytes(r.content) for r in files.collect()} == {got["a b"]: b"1", got["c/d é"]: b"2"}
    with pytest.raises(Exception, match="repeated key"):
        file_sink.write_masks(df.union(df), str(tmp_path / "masks"))
    assert len(listed(tmp_path / "masks")) == 2
    document = next((tmp_path / "m").glob("part-*")).read_text()
    import json

    assert json.loads(document)["metadata"] == {"dataset": "d", "num_samples": 1, "h_sample_step": 10}
    writers.write_ground_truth(samples.limit(0), str(tmp_path / "m0"), "d")
    assert readers.manifest(spark, str(tmp_path / "m0")).count() == 0
