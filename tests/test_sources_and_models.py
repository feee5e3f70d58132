"""Readers on small fixtures, resumable ingestion, and models against numpy."""

import json

import numpy as np
import pytest

from pavestat.operators import models
from pavestat.sources import readers, writers
from pavestat.streaming.ingest import ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_dataset_readers(spark, tmp_path):
    line = json.dumps({"raw_file": "a.jpg", "lanes": [[-2, 5, 6], [-2, -2, 7]], "h_samples": [1, 2, 3]})
    row = readers.tusimple(spark, put(tmp_path / "t.json", f"{line}\nbroken\n")).collect()
    assert len(row) == 1 and [[tuple(p) for p in lane] for lane in row[0].lanes] == [[(5, 2), (6, 3)]] and row[0].height == 720
    put(tmp_path / "c" / "00.lines.txt", "100 200 300 400\n500 100 600\n1 x 2 3\n")
    lanes = readers.culane_lines(spark, str(tmp_path / "c")).first().lanes
    assert [[tuple(p) for p in lane] for lane in lanes] == [[(100, 200), (300, 400)]]
    frames = readers.culane_list(spark, put(tmp_path / "test0_normal.txt", "/d/1.jpg /d/1.png 1\n\n")).collect()
    assert [tuple(f) for f in frames] == [("d/1.jpg", "clear")]
    put(tmp_path / "v" / "a.json", '{"Lines": [[{"x": "1.0", "y": "2.0"}, {"x": "no", "y": "1"}, {"x": "3", "y": "4"}], [{"x": "1", "y": "1"}]]}')
    put(tmp_path / "v" / "b.json", "{}")
    got = {r.sample_id[-6:]: [[tuple(p) for p in lane] for lane in r.lanes] for r in readers.curvelanes(spark, str(tmp_path / "v")).collect()}
    assert got == {"a.json": [[(1, 2), (3, 4)]], "b.json": []}
    put(tmp_path / "i" / "x.jpg", "-"), put(tmp_path / "m" / "x.png", "-"), put(tmp_path / "n" / "y.png", "-")
    assert readers.image_pairs(spark, str(tmp_path / "i"), str(tmp_path / "m")).count() == 1
    with pytest.raises(ValueError, match="no image"):
        readers.image_pairs(spark, str(tmp_path / "i"), str(tmp_path / "n"))


def test_scenarios_masks_and_attributes(spark, tmp_path):
    lists = {"test0_normal": "clear", "test1_crowd": "crowded", "test2_hlight": "dazzle", "test3_shadow": "shadow", "test4_noline": "no_marking", "test5_arrow": "arrow", "test6_curve": "curve", "test7_cross": "cross", "test8_night": "night", "val": None}
    for stem in lists:
        put(tmp_path / "list" / f"{stem}.txt", f"/d/{stem}.jpg\n")
    root = tmp_path / "root"
    args = (spark, str(tmp_path / "list"), str(root))
    want = {f"d/{k}.jpg": (v, "night" if v == "night" else None) for k, v in lists.items()}
    assert {r.sample_id: (r.scenario, r.timeofday) for r in readers.culane_list(*args).collect()} == want
    for name in ("laneseg_label_w16_test/d/val", "laneseg_label_w16/d/val", "laneseg_label_w16_test/d/test8_night"):
        put(root / f"{name}.png", "-")
    rows = readers.culane_list(*args).collect()
    assert {r.sample_id: (r.scenario, r.timeofday) for r in rows} == want and len(rows) == len(want)
    masks = {r.sample_id: r.mask_path.split("/root/")[-1] for r in rows if r.mask_path}
    assert masks == {"d/val.jpg": "laneseg_label_w16/d/val.png", "d/test8_night.jpg": "laneseg_label_w16_test/d/test8_night.png"}
    for x in "xyz":
        put(tmp_path / "i" / f"{x}.jpg", "-"), put(tmp_path / "m" / f"{x}.png", "-")
    put(tmp_path / "a" / "x.json", '{"attributes": {"weather": "rainy", "scene": "tunnel", "timeofday": "night"}}'), put(tmp_path / "a" / "y.json", "{")
    pairs = readers.image_pairs(spark, str(tmp_path / "i"), str(tmp_path / "m"), str(tmp_path / "a")).collect()
    assert {r.sample_id: (r.weather, r.scene, r.timeofday) for r in pairs} == {"x": ("rainy", "tunnel", "night"), "y": (None,) * 3, "z": (None,) * 3}


def test_manifests_records_and_runs(spark, tmp_path):
    samples = [{"sample_id": "a", "ground_truth": {"mask_path": "m/a.png", "meta": {"k": 1}}}, {"sample_id": "b", "ground_truth": {"mask_path": "/b.png", "k": 2}}]
    got = readers.manifest(spark, put(tmp_path / "g.json", json.dumps({"samples": samples})), ("k",)).orderBy("position").collect()
    assert [r.k for r in got] == ["1", "2"] and got[0].mask_path.endswith(f"{tmp_path}/m/a.png") and got[1].mask_path == "/b.png"
    lanes = [[{"x": 1, "y": 2}, [3, 4]], [[1, 1]], [[1, 1], ["NaN", 2], [5, 5]]]
    pred = [{"sample_id": "a", "prediction": {"polylines": lanes, "scores": [0.5, 0.6, 0.7]}}, {"sample_id": "b", "prediction": {"mask_path": "q.png"}}, {"sample_id": "c", "prediction": {}}]
    p = readers.predictions(spark, put(tmp_path / "p.json", json.dumps(pred))).orderBy("position").collect()
    assert p[0].scores == [0.5, 0.7] and [len(x) for x in p[0].lanes] == [2, 2]
    assert [r.geometry_source for r in p] == ["polyline", "mask", "unavailable"] and p[1].scores is None
    run = readers.tag_run(spark, put(tmp_path / "r.jsonl", '{"sample_id": "a", "dataset": "1"}\nbad\n{"sample_id": "a", "dataset": "2"}\n')).collect()
    assert [(r.sample_id, r.dataset) for r in run] == [("a", "2")]
    put(tmp_path / "s" / "1.json", '{"model": "m", "metrics": {"lane_iou": 0.5}}'), put(tmp_path / "s" / "2.json", "[]")
    assert [r.lane_iou for r in readers.summaries(spark, str(tmp_path / "s")).collect()] == [0.5]
    assert readers.sniffed_csv(spark, put(tmp_path / "d.csv", "a;b\n1;2\n")).columns == ["a", "b"]
    assert readers.frozen_config(spark, str(tmp_path / "none.json")) is None
    with pytest.raises(ValueError):
        readers.frozen_config(spark, put(tmp_path / "bad.json", "[1]"))
    rows = spark.createDataFrame([(1.0, "x", {"w": "rain"}, [1])], "z double, id string, metadata map<string,string>, l array<int>")
    assert writers.flat(rows, ["id"]).columns == ["id", "z", "metadata.w"]


def test_ingestion_resumes(spark, tmp_path):
    args = (spark, str(tmp_path / "in"), "sample_id string, v int", str(tmp_path / "out"), str(tmp_path / "cp"))
    put(tmp_path / "in" / "1.json", '{"sample_id": "a", "v": 1}\n{"sample_id": "a", "v": 1}\n{"v": 3}\n')
    ingest(*args).awaitTermination(60)
    put(tmp_path / "in" / "2.json", '{"sample_id": "a", "v": 9}\n{"sample_id": "b", "v": 2}\n')
    ingest(*args).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1), ("b", 2)]


def test_models_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    y, n = 1 + 2 * a - b + rng.normal(size=400), rng.poisson(np.exp(0.3 + 0.5 * a))
    one = (rng.random(400) < 1 / (1 + np.exp(-a + 0.5))).astype(float)
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist(), y.tolist(), n.tolist(), one.tolist(), strict=True), (None, 1.0, 1.0, 1, 1.0)], "a double, b double, y double, n long, one double")
    x = np.column_stack([np.ones(400), a, b])
    fit = models.ols(df, "y", ["a", "b"])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = (y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inverse, x))
    assert fit.rows == 400 and np.allclose(fit.coef, beta) and np.allclose(fit.covariance, inverse @ (x.T * e**2) @ x @ inverse)
    for name, target, mean in (("poisson", n, np.exp), ("binomial", one, lambda t: 1 / (1 + np.exp(-t)))):
        got = models.glm(df, {"poisson": "n", "binomial": "one"}[name], ["a", "b"], name)
        assert np.allclose(x.T @ (target - mean(x @ got.coef)), 0, atol=1e-6)
    assert models.auc(df.limit(0), "one", "a").first().auc is None


def test_array_expressions_on_edge_cases(spark):
    from pyspark.sql import functions as F

    from pavestat.functions import expr as E

    df = spark.createDataFrame([(1, [0.0, 5.0, 0.1, -5.0, None, 5.0]), (2, []), (3, None), (4, [5.0, -5.0])], "id int, x array<double>")
    x = F.col("x")
    got = df.select("id", E.reversals(x, 1.0, 0.0).alias("r"), E.reversals(x, 1.0, 0.5).alias("far"), E.arc_length(x, F.transform(x, lambda _, i: i.cast("double"))).alias("l"), E.autocorrelation(x, x, 2).alias("c")).orderBy("id").collect()
    assert [r["r"] for r in got] == [2, 0, None, 1] and [r["far"] for r in got][0] == 0
    assert [r["l"] for r in got][1:3] == [0.0, None] and got[3]["l"] == pytest.approx((100 + 1) ** 0.5)
    assert [r["c"] for r in got][1:] == [0.0, None, 0.0]
    wave = spark.createDataFrame([([1.0, 0.0, -1.0, 0.0] * 8,)], "x array<double>").select(E.autocorrelation(x, F.transform(x, lambda _: F.lit(1.0)), 4).alias("same"), E.autocorrelation(x, F.transform(x, lambda _: F.lit(1.0)), 2).alias("against")).first()
    assert wave["same"] == pytest.approx(1.0) and wave["against"] == 0.0


def test_cross_validation_by_families(spark):
    import numpy as np

    from pyspark.sql import functions as F

    from pavestat.operators import models

    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(rng.poisson(np.exp(0.3 * x))), None if i % 17 == 0 else float(2 * x + 1)) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    fold = F.col("id") % 3
    exact = models.cross_validate(df, "z", ["x"], fold).orderBy("fold").collect()
    assert sum(r["n"] for r in exact) == sum(r[3] is not None for r in rows) and all(r["rmse"] < 1e-8 for r in exact)
    assert {r["n"] for r in models.cross_validate(df, "y", ["x"], fold, "poisson").collect()} == {100}
    assert models.cross_validate(df.limit(0), "z", ["x"], fold).count() == 0
