"""Kernels on markings, records of images, and the readers and models of this kind."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavestat.functions import markings as M
from pavestat.functions import raster
from pavestat.operators import frames, models
from pavestat.sources import readers, writers


def brute_distance(mask):
    zero = np.argwhere(mask == 0)
    out = np.zeros(mask.shape)
    for y, x in np.argwhere(mask != 0):
        d = np.abs(zero - (y, x))
        out[y, x] = (M.DIAGONAL * d.min(axis=1) + M.ACROSS * (d.max(axis=1) - d.min(axis=1))).min()
    return out


def test_border_distance_is_the_least_path():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.9, 0.98):
        mask = rng.random((23, 31)) < share
        assert np.allclose(M.border_distance(mask), brute_distance(mask))
    assert M.stroke_width(np.zeros((4, 4))) == 0


def test_thin_predictions_are_widened_to_the_reference():
    gt, pred = np.zeros((80, 80), bool), np.zeros((80, 80), bool)
    gt[:, 30:50], pred[:, 39:41] = True, True
    wide, own, wanted, was = M.standardised(pred, gt)
    assert was and wanted > own and wide.sum() > 4 * pred.sum()
    assert not M.standardised(gt, pred)[3] and M.standardised(np.zeros((5, 5)), gt[:5, :5])[1] is None
    g, p, miss = M.missed(gt, np.zeros_like(gt), (40, 40))
    assert g.shape == (40, 40) and (miss == g).all() and not p.any()


def test_confidence_over_predicted_pixels():
    pred = np.zeros((20, 20), bool)
    pred[5:10, 5:10] = True
    assert M.confidence(None, pred) is None and M.confidence(np.where(pred, 0.8, 0.2), pred) == pytest.approx(0.8)
    assert M.confidence(np.full((20, 20), 0.5), np.zeros((20, 20))) == 0


def test_skeleton_is_thin_and_connected():
    mask = np.zeros((40, 60), bool)
    mask[5:35, 20:29] = True
    thin = M.skeleton(mask)
    assert 15 < thin.sum() < 40 and (thin.sum(axis=1) <= 2).all() and raster.components(thin).max() == 1 and not (thin & ~mask).any()
    assert not M.skeleton(np.zeros((3, 3))).any()
    assert len(M.along(np.array([[0, 0], [0, 10.0]]))) == 11 and M.centre_points(None, None)[1] == "empty"


def test_parts_by_their_moments():
    mask = np.zeros((100, 100), bool)
    mask[10:50, 20:24], mask[70:72, 60:90] = True, True
    found = M.shapes(mask)
    assert found["area"].tolist() == [160, 60] and found["major"][0] >= 40 and found["x"].tolist() == [21.5, 74.5]
    by_cov = np.sqrt(np.linalg.eigvalsh(np.cov(np.argwhere(mask[:60]), rowvar=False))[-1]) * 4
    assert found["major"][0] == pytest.approx(max(by_cov, 40))
    assert M.thickness(np.zeros((3, 3)))["score"] is None and 0 <= M.thickness(mask)["score"] <= 1


def dashed(step=40, dash=20, height=320, width=360, worn=()):
    mask = np.zeros((height, width), bool)
    for k, y in enumerate(range(0, height - dash, step)):
        if k not in worn:
            mask[y : y + dash, 175:185] = True
    return mask


def test_patterns():
    assert M.pattern(dashed())["pattern"] == "dashed" and M.instances(dashed()) == 1
    solid = np.zeros((320, 360), bool)
    solid[:, 175:185] = True
    assert M.pattern(solid)["pattern"] == "solid" and M.pattern(np.zeros((9, 9)))["pattern"] == "unknown"
    assert M.pattern(solid, told="style: double Dashed")["pattern"] == "dashed" and M.told_pattern("solid broken") == "mixed"
    assert M.topology(dashed()) == (1, 8, 0.8) and M.topology(np.zeros((9, 9)))[2] is None


def test_closing_of_runs_with_even_and_odd_sizes():
    seq = np.array([1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 1], bool)
    assert M.closed(seq, 3).tolist() == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1]
    for size in (2, 4, 5):
        n, wide = len(seq), []
        window = lambda i, s=size: range(max(0, i - s // 2), min(len(seq), i - s // 2 + s))
        wide = [any(seq[j] for j in window(i)) for i in range(n)]
        assert M.closed(seq, size).tolist() == [all(wide[j] for j in window(i)) for i in range(n)]


def scene(paint):
    image = np.full((320, 360, 3), 70, np.uint8)
    image[paint] = 220
    return image


def test_wear_of_solid_dashed_worn_and_dark_lanes():
    lane = [np.array([[180.0, y] for y in range(0, 320, 10)])]
    solid = np.zeros((320, 360), bool)
    solid[:, 175:185] = True
    assert M.wear(scene(solid), lane)["I1"] == pytest.approx(1, abs=0.03) and M.wear(scene(solid), lane)["condition"] == "intact"
    assert M.wear(scene(dashed()), lane)["I1"] > 0.9
    gone = M.wear(scene(dashed(worn=(5, 6, 7))), lane)
    assert gone["I1"] < 0.75 and gone["condition"] == "worn_or_broken"
    assert M.wear(scene(np.zeros((320, 360), bool)), lane)["I1"] == pytest.approx(0, abs=0.01)
    assert M.wear(scene(solid), [])["unavailable_reason"] == "no_credible_geometry"
    yellow = np.full((320, 360, 3), 70, np.uint8)
    yellow[solid] = (90, 80, 0)
    assert M.wear(yellow, lane)["I1"] > 0.8


def test_guides_from_lanes_then_mask():
    mask = dashed()
    lines, source = M.guidance(mask.shape, None, None, mask)
    assert source == "gt_mask_grouped_centerline" and len(lines) == 1 and abs(lines[0][:, 0] - 179.5).max() <= 1
    assert M.guidance(mask.shape, [np.array([[10, 0], [10, 300.0]])], None, mask)[1] == "native_gt_polyline"
    assert M.guidance(mask.shape, None, None, np.zeros_like(mask)) == ([], None)
    off = np.array([[100.0 + (40 if y == 150 else 0), y] for y in range(0, 300, 10)])
    assert M.guiding_lines([off], (320, 360))[0][0][:, 0].max() < 105


def lane(x, height=100):
    return [[float(x), float(y)] for y in range(10, height + 1, 10)]


def test_drawn_lanes_that_leave_the_image_keep_their_direction():
    steep = np.array([[90.0, 0.0], [190.0, 100.0]])
    kept, moved = raster.rasterise([steep], 100, 100, 10, moved=False), raster.rasterise([steep], 100, 100, 10)
    assert kept.sum() < moved.sum() and kept[50:].sum() == 0 and kept[0, 90]
    assert raster.lane_matches([np.array(lane(100))], [np.array(lane(100)), np.array(lane(400))], 120, 500) == (1, 0, 1)
    assert raster.lane_matches([np.array(lane(450))], [np.array(lane(100))], 120, 500) == (0, 1, 1)


def png(mask):
    return raster.write_png(np.asarray(mask, np.uint8) * 255)


def test_detection_records_of_lanes_and_masks(spark):
    column = np.zeros((100, 80), bool)
    column[:, 40] = True
    told = {"h_samples": list(range(10, 100, 10)), "lanes": [[40] * 9]}
    prob = np.where(column, 0.9, 0.1).astype("<f4").tobytes()
    rows = [("a", png(column), png(column), [lane(40, 90)], told, prob, "Occluded; x"), ("b", None, png(column), None, None, None, None), ("c", png(column), png(np.zeros((100, 80))), None, None, None, "Clearly Visible"), ("d", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "sample_id string, pred binary, gt binary, lanes array<array<array<double>>>, json struct<h_samples: array<int>, lanes: array<array<int>>>, prob binary, seen string")
    plain = frames.detection_records(df, pred_lanes="lanes", gt_json="json", prob="prob", visibility="seen", widened=False)
    assert not [c for c in plain.columns if c.startswith(("D3p_", "D4p_", "D6p_"))]
    got = {r.sample_id: r for r in frames.detection_records(df, pred_lanes="lanes", gt_json="json", prob="prob", visibility="seen", delta=0.01, widened=False).collect()}
    assert (got["a"].D3p_support_f1, got["a"].D3p_pred_source, got["a"].D2_pred_count_source, got["a"].D2_count_match, got["a"].D5_visibility_group) == (1, "native_polyline", "native_polyline", 1, "occluded")
    assert got["a"].D7_confidence_mean == pytest.approx(0.9) and got["a"].D6p_unsupported_marking_ratio == 0
    assert (got["b"].D1_detection, got["b"].D6_image_missed_ratio, got["b"].D3_f1, got["b"].D3p_support_precision, got["b"].D7_confidence_mean) == (0, 1, 0, None, None)
    assert (got["c"].D3_iou, got["c"].D2_count_match, got["c"].D_gt_eligible) == (None, None, 0) and "neither mask" in got["d"].reason


def test_records_of_drawn_frames(spark):
    drawn = readers.drawn_samples(spark, 3, 240, 320)
    got = frames.metric_records(drawn, keep=("sample_id", "weather")).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == ["dry_0000", "dry_0001", "dry_0002"] and got[0].weather == "clear"
    assert all(r.marking_reason is None and r.detection_reason is None and 0 < r.R1_marking_readability_score <= 100 and 0 < r.R2_reference_detectability_score <= 100 for r in got)
    assert got[0].D3_recall < got[1].D3_recall and got[1].I6_marking_instance_count == 3 and "image" not in got[0]
    assert frames.missed_masks(drawn.limit(1), height=24, width=32).first().missed_panel[:4] == b"\x89PNG"
    assert 0 < frames.darkness(drawn.limit(1)).first().dark_share < 1


def test_tusimple_points_may_be_fractions(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"raw_file": "clips/a/1.jpg", "lanes": [[-2, 10.5, 11]], "h_samples": [10, 20, 30]}) + "\n{broken\n")
    row = readers.dataset(spark, "tusimple", str(tmp_path)).first()
    assert row.sample_id == "clips_a_1.jpg" and [(p.x, p.y) for p in row.lanes[0]] == [(10.5, 20), (11, 30)]
    with pytest.raises(KeyError):
        readers.dataset(spark, "other")
    n, shown = readers.inspect(readers.dataset(spark, "tusimple", str(tmp_path)))
    assert n == 1 and shown.first().n_lanes == 1


def test_results_of_the_last_folder_count(spark, tmp_path):
    for folder, value in (("one", 1), ("two", 2)):
        (tmp_path / folder / "per_image").mkdir(parents=True)
        (tmp_path / folder / "per_image" / "net_bdd100k_lane_per_image.csv").write_text(f"sample_id,f1\na,{value}\n")
    (tmp_path / "one" / "per_image" / "net_culane_per_image_metrics.csv").write_text("sample_id,f1,model\nb,5,own\n")
    got = readers.per_image_results(spark, [str(tmp_path / x) for x in ("none", "one", "two")])
    assert sorted((r.model, r.dataset, r.f1) for r in got.collect()) == [("net", "bdd100k_lane", "2"), ("own", "culane", "5")]
    with pytest.raises(ValueError):
        readers.per_image_results(spark, [str(tmp_path / "none")])


def test_answers_of_a_tagger(spark):
    said = ['```json\n{"Wear": {"tags": ["faded /worn", "odd"], "why": "dull"}}\n``` done', 'x {"Wear": ["Clear", "clear"]} {', '{"Wear": "Clear"}', "no object", '{"Wear": [', None]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k")
    got = [r[0] for r in rows.select(readers.answered_tags(F.col("s"), "Wear", ["Faded / Worn", "Clear"])).collect()]
    assert [list(g.tags) for g in got] == [["Faded / Worn"], ["Clear"], ["Clear"], [], [], []]
    assert list(got[0].unmatched) == ["odd"] and got[0].why == "dull"
    assert spark.range(1).select(readers.moved(F.lit("/old/a/b.png"), {"/old/a": "/new"})).first()[0] == "/new/b.png"


def test_published_model_table(spark):
    rows = [("yolopx", "tusimple", "test", 2782, 0.4960, 0.6631, 0.6340, 0.6950), ("yolopx", "culane", "test", 34680, 0.2626, 0.4159, 0.4616, 0.3785), ("yolopx", "curvelanes", "valid", 20000, 0.3845, 0.5554, 0.5292, 0.5844), ("yolopx", "bdd100k_lane", "val", 10000, 0.2006, 0.3342, 0.2058, 0.8893)]
    text = writers.model_table(spark.createDataFrame(rows, "model string, dataset string, split string, num_images int, lane_iou double, lane_f1 double, lane_precision double, lane_recall double"))
    assert "| yolopx | 0.3359 | 0.4922 | 0.4577 | 0.6368 | 0.7430 |" in text or "| yolopx | 0.3359 | 0.4921 | 0.4577 | 0.6368 | 0.7430 |" in text or "| yolopx | 0.3359 | 0.4921 | 0.4576 | 0.6368 | 0.7430 |" in text


def counts(spark, n=400):
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=n), rng.integers(0, 20, n)
    y = rng.negative_binomial(2, 2 / (2 + np.exp(0.5 + 0.6 * x)))
    return x, g, y, spark.createDataFrame([(float(a), int(b), int(c), "abc"[b % 3], 1.0) for a, b, c in zip(x, g, y, strict=True)], "x double, g int, y int, c string, one double")


def test_negative_binomial_and_its_covariances(spark):
    x, g, y, df = counts(spark)
    fit = models.glm(df, "y", ["x"], "negative_binomial")
    alpha = max((y.var(ddof=1) - y.mean()) / y.mean() ** 2, 1e-8)
    d, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(60):
        mu = np.exp(d @ beta)
        w = mu / (1 + alpha * mu)
        beta = np.linalg.solve(d.T @ (w[:, None] * d), d.T @ (w * (d @ beta + (y - mu) / mu)))
    assert fit.alpha == pytest.approx(alpha) and np.allclose(fit.coef, beta)
    bread = np.linalg.inv(d.T @ (w[:, None] * d))
    score = d * ((y - mu) / (1 + alpha * mu))[:, None]
    own = np.stack([score[g == k].sum(axis=0) for k in range(20)])
    want = bread @ (own.T @ own) @ bread * 20 / 19 * (len(x) - 1) / (len(x) - 2)
    assert np.allclose(models.robust(df, fit, "y", "g").covariance, want)
    lever = np.einsum("ij,jk,ik->i", d, bread, d) * w
    white = (score / (1 - lever)[:, None]).T @ (score / (1 - lever)[:, None])
    assert np.allclose(models.robust(df, fit, "y").covariance, bread @ white @ bread)
    q = models.quality(df, fit, "y")
    like = sum(math.lgamma(k + 1 / alpha) - math.lgamma(1 / alpha) - math.lgamma(k + 1) + k * math.log(alpha * m / (1 + alpha * m)) - math.log(1 + alpha * m) / alpha for k, m in zip(y.tolist(), mu.tolist(), strict=True))
    assert q["log_likelihood"] == pytest.approx(like, rel=1e-8) and q["AIC"] == pytest.approx(4 - 2 * like)
    with pytest.raises(ValueError):
        models.robust(df.where("g < 5"), fit, "y", "g")
    with pytest.raises(ValueError):
        models.glm(df.withColumn("y", F.lit(0)), "y", ["x"], "poisson")


def test_design_and_the_whole_flow(spark, tmp_path):
    *_, df = counts(spark)
    d = models.design(df, "y", ["x", "c", "one"], ["c"], standardise=True)
    assert d.xs == ["x", "c_b", "c_c"] and "constant" in d.notes[0] and abs(d.df.agg(F.avg("x")).first()[0]) < 1e-12
    for bad in (dict(df=df.limit(5)), dict(xs=["one"]), dict(df=df.withColumn("z", 2 * F.col("x")), xs=["x", "z"])):
        with pytest.raises(ValueError):
            models.design(**({"df": df, "y": "y", "xs": ["x"]} | bad))
    found = models.explore(df, "y", ["x", "c", "big"], ["c"], derived=[{"name": "big", "operation": "threshold", "columns": ["x"], "value": 1}, {"name": "bad", "operation": "sum", "columns": ["none"]}], group="g")
    assert found["family"] == "negative_binomial" and found["errors"] == ["bad: missing source column(s): none"] and found["coefficients"].count() == 5
    assert found["cross_validation"].agg(F.sum("n")).first()[0] == 400
    models.write_results(found, str(tmp_path / "out"), {"outcome": "y"})
    assert spark.read.parquet(str(tmp_path / "out/coefficients")).count() == 5 and spark.read.json(str(tmp_path / "out/statistics")).count() > 5
    text = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert models.recommend(text, {"v": F.col("v")}).first().v is None and models.recommend(text.limit(2), {"v": F.col("v")}).first().v == "binomial"
    assert models.adjusted_regression(df.limit(9), y="y", x="x", others=(), effects=("c",), space="c")["reason"] == "insufficient_samples_n_lt_30"
