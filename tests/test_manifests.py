import json

import pytest

from pavestat.functions import raster
from pavestat.sources import readers, writers

LANE = [[30.0, 0.0], [30.0, 99.0]]


def test_lane_and_prediction_manifests(spark, tmp_path):
    mask = raster.write_png(raster.rasterise([LANE], 100, 80, 6) * 255)
    rows = [("a", [LANE], [0.5], None), ("b", None, None, mask), ("c", None, None, None), ("d", [[[1.0, 1.0]], LANE], [0.1, 0.9], None), ("e", [LANE], None, None)]
    df = spark.createDataFrame([(*r, 100, 80) for r in rows], "sample_id string, lanes array<array<array<double>>>, scores array<double>, mask binary, height int, width int")
    got = {r["sample_id"]: r for r in writers.prediction_manifest(df).collect()}
    assert got["a"]["lane_json"]["lanes"] == [[30] * 9] == got["b"]["lane_json"]["lanes"] and got["a"]["lane_json"]["h_samples"] == list(range(10, 100, 10))
    assert [got[k]["natural_gt"] for k in "abc"] == ["lanes", "mask", None] and got["c"]["lane_json"] is None
    assert [p["score"] for p in got["d"]["polylines"]] == [0.9] and [p["score"] for p in got["e"]["polylines"]] == [None]
    out = str(tmp_path / "m")
    writers.write_manifest(writers.prediction_manifest(df), out, most=2)
    lines = [json.loads(x) for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(x["sample_id"] for x in lines) == ["a", "b"]


def test_output_manifest(spark):
    records = spark.createDataFrame([("a", 0.5, 2.0, 7, "x")], "sample_id string, D3_f1 double, I1_wear double, count int, Dataset string")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    a, b = writers.output_manifest(records, samples).orderBy("sample_id").collect()
    assert a["metrics"]["D"]["D3_f1"] == 0.5 and a["metrics"]["I"]["I1_wear"] == 2.0 and a["metrics"]["core"]["count"] == 7 and a["metrics"]["core"]["Dataset"] == "x" and b["metrics"] is None


def test_resolve_and_stride(spark):
    path = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    names = spark.createDataFrame([("k.JPG",), ("k.JPG",), ("m",), ("gone",), (None,)], "file_name string")
    found = readers.resolve_images(names, path(["/i/train/k.jpg", "/i/val/k.jpg", "/i/test/m.jpg", "/i/other/gone.jpg"]), path(["/m/train/k.png", "/m/val/k.png"])).collect()
    got = sorted((str(r["file_name"]), r["image_path"], r["split"], r["mask_path"], r["note"]) for r in found)
    assert got == [("None", None, None, None, "image not found"), ("gone", None, None, None, "image not found"), *[("k.JPG", "/i/val/k.jpg", "val", "/m/val/k.png", "")] * 2, ("m", "/i/test/m.jpg", "test", None, "mask missing")]
    frames = spark.createDataFrame([(s, i) for s in "ab" for i in range(25)], "seg string, i int")
    assert sorted(map(tuple, readers.strided(frames, "seg", "i").collect())) == [(s, i) for s in "ab" for i in (0, 10, 20)]


def test_tag_table(spark):
    kind = "sample_id string, dataset string, predicted_tags struct<by_dimension: map<string, array<string>>>"
    df = spark.createDataFrame([("a", "d", ({"Road & Light": ["wet", "dark"], "Other": ["x"]},)), ("b", "d", ({},)), ("c", None, None)], kind)
    got = [r.asDict() for r in readers.tag_table(df, ["Road & Light"]).orderBy("sample_id").collect()]
    assert readers.tag_table(df, ["Road & Light"]).columns[3:] == ["wet", "dark"]  # as they first appear
    assert got[0] == {"sample_id": "a", "dataset": "d", "tag_road_light": "wet; dark", "dark": 1, "wet": 1}
    assert got[1]["dark"] == 0 == got[2]["wet"] and got[2]["tag_road_light"] == ""
    with pytest.raises(ValueError, match="repeated"):
        readers.tag_table(df.union(df), ["Other"])
    with pytest.raises(ValueError, match="columns"):
        readers.tag_table(spark.createDataFrame([("a", "d", ({"Other": ["dataset"]},))], kind), ["Other"])
