"""Scores, associations and localisation on tables made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pavestat.functions import expr as E
from pavestat.operators import joins as J
from pavestat.operators import localization as L
from pavestat.operators import readiness as D


def test_missing_confidence_renormalises_the_score(spark):
    row = spark.createDataFrame([(1.0, 0.5, 1.0, 0.0, None)], "D3_f1 double, D3_iou double, D4_near_iou double, D6_image_missed_ratio double, D7_confidence_mean double")
    assert row.select(D.r2(row.columns)).first()[0] == pytest.approx((0.35 + 0.10 + 0.20 + 0.20) / 0.95 * 100)
    assert row.select(D.r1(row.columns)).first()[0] is None
    older = spark.createDataFrame([(0.5, "0.5", float("nan"), 1.0)], "I1 double, I2 string, I3 double, I4 double")
    assert older.select(D.r1(older.columns)).first()[0] == pytest.approx(100 * (0.35 * 0.5 + 0.35 * 0.5 + 0.10) / 0.80)


@pytest.fixture
def dozen(spark):
    rows = [(k / 11, k / 11, k / 11, k / 11, k / 11, k / 11, 1 - k / 11, 100 * k / 11, 100 * k / 11, "clear" if k < 6 else "rainy") for k in range(12)]
    names = "I1_pattern_continuity I2_local_contrast I3_boundary_sharpness I5_geometry_complexity D3_f1 D3_iou D6_image_missed_ratio R1_marking_readability_score R2_reference_detectability_score"
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()) + ", weather string")


def test_associations_and_their_reasons(dozen):
    told = {r.name: r for r in D.associations(dozen).collect()}
    assert told["C1"].spearman == pytest.approx(1) and told["C2"].pearson == pytest.approx(1) and told["C1_detected"].spearman == pytest.approx(1)
    few = {r.name: r for r in D.associations(dozen.where("D3_f1 < 0.4")).collect()}
    assert few["C1"].spearman is None and "insufficient_samples" in few["C1"].reason
    flat = {r.name: r for r in D.associations(dozen.withColumn("I2_local_contrast", F.lit(0.5))).collect()}
    assert flat["C2"].spearman is None and flat["C2"].reason == "zero_variance"


def test_summary_of_a_dozen(dozen):
    s = D.summary(dozen, 5).first()
    assert s.num_records == 12 and s.C4 == pytest.approx(-0.5454545) and s.C5.condition == "clear"
    assert s.layer_r3.name == "low pattern continuity" and s.layer_r3.strength == pytest.approx(1)
    assert D.condition_key(dozen) == "weather" and D.condition_key(dozen.where("weather = 'clear'")) is None
    drops = {r.condition: r for r in D.degradation(dozen, "weather", 5).collect()}
    assert drops["rainy"].degradation == pytest.approx(2 * (2.5 - 8.5) / 11) and drops["rainy"].baseline == "clear"
    assert D.degradation(dozen.where("weather = 'clear'"), "weather", 5).count() == 0


def test_summary_carries_the_interval_of_the_thirds(dozen):
    own = dozen.withColumn("I5_alignment_complexity", 1 - F.col("D3_f1"))
    s = D.summary(own, 5, ties=["D3_iou"]).first()
    low, high = own.orderBy("I5_alignment_complexity").limit(4).agg(F.avg("D3_f1")).first()[0], own.orderBy(F.desc("I5_alignment_complexity")).limit(4).agg(F.avg("D3_f1")).first()[0]
    assert s.num_records == 12 and s.C4_tertile.n_bottom == 4 and s.C4_tertile.effect == pytest.approx(low - high)
    assert s.C4_tertile.ci_low < s.C4_tertile.effect < s.C4_tertile.ci_high
    assert "C4_tertile" not in D.summary(dozen, 5, ties=["D3_iou"]).columns


def test_probability_of_a_correlation(spark):
    assert D._tail(0.5, 10) == pytest.approx(0.14111, abs=1e-5) and D._tail(0.9, 30) == pytest.approx(1.22e-11, rel=0.02)
    assert D._tail(1.0, 10) == 0 and D._tail(0.0, 10) == pytest.approx(1) and D._tail(0.5, 2) is None
    rows = spark.createDataFrame([(float(k), float(k * k % 7)) for k in range(20)], "x double, y double")
    got = D.association(rows, F.col("x"), F.col("y"), p_values=True).first()
    assert 0 < got.pearson_p <= 1 and got.n == 20


def test_classes_and_bottleneck(spark):
    rows = spark.createDataFrame([(85.0, 90.0), (85.0, None), (10.0, 59.0), (None, None)], "a double, b double").select(D.r4(F.col("a"), F.col("b")).alias("c")).select("c.*").collect()
    assert [r.status.split("_")[0] for r in rows] == ["HIGH", "MODERATE", "LOW", "LOW"] and rows[3].reason == "no score could be computed"
    one = spark.range(1).select(D.bottleneck([("a", F.lit(-0.5), "x"), ("b", F.lit(0.5), "y"), ("c", F.lit(None).cast("double"), "z")]).alias("b")).first().b
    assert (one.name, one.strength) == ("a", 0.5)
    assert spark.range(1).select(D.bottleneck([("a", F.lit(None).cast("double"), "x")]).alias("b")).first().b.name == "unavailable"


POINTS = "pred array<struct<x: double, y: double>>, gt array<struct<x: double, y: double>>, w int, h int"


def test_localisation_of_empty_and_near_sides(spark):
    line = [(10.0, float(y)) for y in range(0, 100, 10)]
    rows = [(line, line, 300, 400), ([], line, 300, 400), (line, [], 300, 400), ([], [], 300, 400), ([(x + 10, y) for x, y in line], line, 300, 400), (None, line, 300, 400)]
    got = L.localise(spark.createDataFrame(rows, POINTS), "pred", "gt", "w", "h", 0.015).collect()
    assert (got[0].D3p_support_f1, got[0].D3p_loc_err_p95, got[0].D6p_unsupported_marking_ratio) == (1, 0, 0)
    assert (got[1].D3p_support_recall, got[1].D3p_support_precision, got[1].D3p_support_f1, got[1].D3p_loc_err_median) == (0, None, None, None)
    assert (got[2].D3p_support_recall, got[2].D3p_support_precision) == (None, 0) and got[3].D3p_support_f1 is None
    assert got[4].D3p_support_f1 == 0 and got[4].D3p_loc_err_median == pytest.approx(0.02)
    assert got[0].D4p_upper_f1 == 1 and got[0].D4p_lower_f1 is None and got[5].D3p_n_pred_points == 0
    with pytest.raises(ValueError):
        L.localise(spark.createDataFrame(rows, POINTS), "pred", "gt", "w", "h", float("nan"))
    s = L.summarise(L.localise(spark.createDataFrame(rows, POINTS), "pred", "gt", "w", "h", 0.015)).first()
    assert s.D3p_num_scored == 6 and s.D3p_deltas == [0.015] and s.D3p_support_f1_mean == pytest.approx(0.5)


def test_distances_to_a_diagonal(spark):
    d = spark.range(1).select(L.diagonal(F.lit(3), F.lit(4))).first()[0]
    near = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0)], [(0.0, 0.0)])], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    assert d == 5 and near.select(L.nearest(F.col("a"), F.col("b"))).first()[0] == [0, 5]
    assert near.select(L.nearest(F.col("a"), F.array().cast("array<struct<x: double, y: double>>"))).first()[0] == [math.inf, math.inf]


def test_tolerance_and_its_stability(spark):
    rows = [(k, [0.01 * (1 + (k + j) % 5) for j in range(20)], [0.01 * (1 + (k * j) % 5) for j in range(20)]) for k in range(40)] + [(40, [], [])]
    df = spark.createDataFrame(rows, "k int, f array<double>, b array<double>")
    grid = [0.005, 0.015, 0.025, 0.035, 0.045, 0.055, 0.1, 0.2, 0.3]
    one = L.select_delta(df, ["k"], "f", "b", grid).first()
    assert one.selection_rule == "f1_knee" and one.delta_selected == 0.055 and one.delta_percentile == pytest.approx(0.05)
    boot = L.bootstrap_knee(df, "f", "b", grid, draws=30).first()
    assert boot.n_boot == 30 and boot.median == 0.055 and boot.stable_within_one_grid_step
    assert L.bootstrap_knee(df, "f", "b", grid, draws=30).first() == boot
    none = L.select_delta(df.where("k = 40"), ["k"], "f", "b", grid).first()
    assert none.selection_rule == "undefined_insufficient_data" and none.delta_selected is None


def test_conflicting_tags_and_names(spark):
    rows = spark.createDataFrame([(["Clearly Visible", "Occluded "],), (["clearly visible"],), (None,)], "t array<string>")
    got = [tuple(r[0]) for r in rows.select(E.unconflicted(F.col("t"))).collect()]
    assert got == [(["Occluded "], ["Clearly Visible"]), (["clearly visible"], []), ([], [])]
    names = spark.createDataFrame([("a/b\\c.d.png", " Faded /Worn  x")], "p string, t string")
    assert tuple(names.select(E.stem(F.col("p")), E.safe_name(F.col("p")), E.normal_tag(F.col("t"))).first()) == ("c.d", "a_b_c.d.png", "faded / worn x")
    assert names.select(E.root_mean_square(F.lit(3.0), F.lit(None), F.lit(4.0))).first()[0] == pytest.approx(math.sqrt(12.5))
    assert sum(names.select(E.softmax(F.array(F.lit(1.0), F.lit(2.0)))).first()[0]) == pytest.approx(1)


def test_repeated_keys_of_unique_tables_fail(spark):
    base, twice = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    assert J.combined(base, {"t": (twice, "id", ["v"])}, {}).orderBy("id").collect()[1].t_v == "a"
    with pytest.raises(Exception, match="repeated key"):
        J.combined(base, {}, {"t": (twice, "id")}).collect()
    few = J.positional(base, twice.withColumnRenamed("id", "k"), ["id"], ["v"])
    assert few.where("v is not null").count() == 0 and few.count() == 3
