"""Readiness, localisation, joins and filters on the driver's tables, with their SQL.

A record is a row of ``lineitem``, its weather the return flag, its scene the line status; an
image of points is an order, its reference the lines of odd number, its prediction the others.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import evaluation as V
from ..operators import joins as J
from ..operators import localization as L
from ..operators import order as O
from ..operators import readiness as D
from .metric_queries import Query, r, table

READINESS_QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        READINESS_QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: The columns of a record, and the same in SQL.
RECORD = {
    "ok": "l_orderkey", "ln": "l_linenumber", "weather": "l_returnflag", "scene": "l_linestatus",
    "I1_pattern_continuity": "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 9.83 END", "I2_local_contrast": "l_tax * 9.71", "I3_boundary_sharpness": "l_quantity / 50",
    "I4_legacy_thickness_stability": "CASE WHEN l_linenumber <> 3 THEN l_discount * 9 END", "I4_lane_width_stability": "l_tax", "I5_geometry_complexity": "l_extendedprice / 105000",
    "D3_f1": "CASE WHEN l_linenumber <> 5 THEN l_quantity / 51.7 + l_tax END", "D3_iou": "l_quantity / 60", "D4_near_iou": "l_discount * 7.03", "D6_image_missed_ratio": "l_tax * 10",
    "D7_confidence_mean": "CASE WHEN l_linenumber = 1 THEN l_discount * 9 END", "D_gt_eligible": "l_linenumber <> 4", "D6_fn_pixels": "l_discount * l_quantity", "D6_gt_pixels": "l_quantity",
    "D5_visibility_group": "CASE l_linenumber WHEN 1 THEN 'clear' WHEN 2 THEN 'occluded' ELSE 'degraded' END", "gt_nonzero": "l_linenumber - 1", "pred_nonzero": "l_linenumber - 2",
}
REC = "WITH rec AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in RECORD.items()) + " FROM lineitem), "


def _weighted(*terms: tuple[str, float]) -> str:
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in terms)
    return f"100 * ({top}) / nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in terms)}, 0)"


R1 = _weighted(("I1_pattern_continuity", 0.35), ("I2_local_contrast", 0.35), ("I3_boundary_sharpness", 0.20), ("I4_legacy_thickness_stability", 0.10))
R2 = _weighted(("D3_f1", 0.35), ("D3_iou", 0.20), ("D4_near_iou", 0.20), ("greatest(0, least(1, 1 - D6_image_missed_ratio))", 0.20), ("D7_confidence_mean", 0.05))
SCORED = REC + f"s AS (SELECT *, {R1} AS r1, {R2} AS r2 FROM rec) "
CLASS = "CASE WHEN r1 >= 80 AND r2 >= 80 THEN 'HIGH' WHEN r1 >= 60 OR r2 >= 60 THEN 'MODERATE' ELSE 'LOW' END || '_MACHINE_READABILITY'"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(sql).alias(name) for name, sql in RECORD.items()])


@query(SCORED + f"SELECT ok, ln, round(r1, 6) AS r1, round(r2, 6) AS r2, {CLASS} AS status FROM s")
def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.scored(records(spark, sf_dir))
    return d.select("ok", "ln", r(F.col("R1_marking_readability_score")).alias("r1"), r(F.col("R2_reference_detectability_score")).alias("r2"), F.col("R4_machine_readability_class.status").alias("status"))


DROPS = """m AS (SELECT weather AS condition, count(*) AS n, avg(r1) / 100 AS a, avg(r2) / 100 AS b FROM s GROUP BY 1 HAVING count(*) >= 10),
 b AS (SELECT * FROM m ORDER BY n DESC, condition LIMIT 1) """


@query(SCORED + ", " + DROPS + """SELECT 'weather' AS condition_key, m.condition AS condition, b.condition AS baseline, m.n AS n, round(b.a - m.a, 6) AS readability_drop,
 round(b.b - m.b, 6) AS detection_drop, round(b.a - m.a + b.b - m.b, 6) AS degradation FROM m, b WHERE (SELECT count(*) FROM m) >= 2""")
def readiness_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.scored(records(spark, sf_dir))
    found = D.degradation(d, D.condition_key(d))
    return found.select("condition_key", "condition", "baseline", "n", *[r(F.col(c)).alias(c) for c in ("readability_drop", "detection_drop", "degradation")])


@query(REC + """p AS (SELECT 'C1' AS name, I1_pattern_continuity AS x, D3_f1 AS y FROM rec UNION ALL SELECT 'C1_detected', I1_pattern_continuity, 1 - D6_image_missed_ratio FROM rec
 UNION ALL SELECT 'C2', I2_local_contrast, D3_iou FROM rec UNION ALL SELECT 'C2_f1', I2_local_contrast, D3_f1 FROM rec
 UNION ALL SELECT 'C3', I3_boundary_sharpness, D3_f1 FROM rec UNION ALL SELECT 'C3_iou', I3_boundary_sharpness, D3_iou FROM rec),
 k AS (SELECT name, x, y, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2 AS ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT name, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson,
 round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman, CASE WHEN count(*) < 10 THEN 'insufficient_samples_n_lt_10' END AS reason FROM k GROUP BY name""")
def record_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.associations(records(spark, sf_dir)).select("name", "n", r(F.col("pearson")).alias("pearson"), r(F.col("spearman")).alias("spearman"), "reason")


GAP = "CASE WHEN count(CASE WHEN D_gt_eligible AND D5_visibility_group = 'clear' THEN 1 END) >= 3 THEN avg(CASE WHEN D_gt_eligible AND D5_visibility_group = 'clear' THEN D3_iou END) - avg(CASE WHEN D_gt_eligible AND D5_visibility_group {} THEN D3_iou END) END"
MEANS = ["I1_pattern_continuity", "I2_local_contrast", "I3_boundary_sharpness", "I4_lane_width_stability", "I4_legacy_thickness_stability", "I5_geometry_complexity", "D3_f1", "D3_iou", "D4_near_iou", "D7_confidence_mean"]


def _corr(name: str, x: str, y: str) -> str:
    return f"""{name} AS (SELECT covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS {name} FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS rx,
 rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2 AS ry FROM rec WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


@query(SCORED + f""", {DROPS}, {_corr("C1", "I1_pattern_continuity", "D3_f1")}, {_corr("C2", "I2_local_contrast", "D3_iou")}, {_corr("C3", "I3_boundary_sharpness", "D3_f1")},
 md AS (SELECT quantile_cont(I5_geometry_complexity, 0.5) AS md FROM rec WHERE D3_f1 IS NOT NULL), C4 AS (SELECT avg(D3_f1) FILTER (I5_geometry_complexity <= md) - avg(D3_f1) FILTER (I5_geometry_complexity > md) AS C4 FROM rec, md),
 C5 AS (SELECT max(b.a - m.a + b.b - m.b) AS C5 FROM m, b),
 g AS (SELECT count(*) AS num_records, count(*) FILTER (gt_nonzero > 0) AS gt_nonzero_images, count(*) FILTER (pred_nonzero > 0) AS pred_nonzero_images, {", ".join(f"avg({m}) AS {m}" for m in MEANS)},
 sum(D6_fn_pixels) FILTER (D_gt_eligible) / sum(D6_gt_pixels) FILTER (D_gt_eligible) AS D6, {GAP.format("= 'occluded'")} AS occlusion_gap, {GAP.format("<> 'clear'")} AS degraded_gap FROM rec),
 h AS (SELECT *, D6 AS D6_image_missed_ratio FROM g), t AS (SELECT *, {R1} AS r1, {R2} AS r2 FROM h),
 z AS (SELECT unnest([{{s: abs(C1), p: 10, n: 'low pattern continuity'}}, {{s: abs(C2), p: 9, n: 'low local contrast'}}, {{s: abs(C3), p: 8, n: 'low boundary sharpness'}}, {{s: abs(C4), p: 7, n: 'geometry sensitivity'}},
 {{s: abs(C5), p: 6, n: 'worst condition stratum'}}, {{s: 1 - I1_pattern_continuity, p: 5, n: 'low pattern continuity'}}, {{s: 1 - I2_local_contrast, p: 4, n: 'low local contrast'}},
 {{s: 1 - I3_boundary_sharpness, p: 3, n: 'low boundary sharpness'}}, {{s: D6, p: 2, n: 'high missed marking ratio'}}, {{s: abs(degraded_gap), p: 1, n: 'occlusion/visibility robustness gap'}}]) AS z FROM t, C1, C2, C3, C4, C5)
 SELECT num_records, gt_nonzero_images, pred_nonzero_images, {", ".join(f"round({m}, 6) AS {m}" for m in MEANS)}, round(D6, 6) AS d6, round(occlusion_gap, 6) AS occlusion_gap, round(degraded_gap, 6) AS degraded_gap,
 round(r1, 5) AS r1, round(r2, 5) AS r2, {CLASS} AS status, round(C1, 6) AS c1, round(C2, 6) AS c2, round(C3, 6) AS c3, round(C4, 6) AS c4, round(C5, 6) AS c5,
 (SELECT z.n FROM z ORDER BY round(z.s, 9) DESC, z.p DESC LIMIT 1) AS bottleneck FROM t, C1, C2, C3, C4, C5""")
def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.summary(D.scored(records(spark, sf_dir)))
    return s.select(
        "num_records", "gt_nonzero_images", "pred_nonzero_images", *[r(F.col(m)).alias(m) for m in MEANS], r(F.col("D6")).alias("d6"), r(F.col("D5_occlusion_robustness_gap")).alias("occlusion_gap"),
        r(F.col("D5_visibility_degraded_gap")).alias("degraded_gap"), r(F.col("layer_r1"), 5).alias("r1"), r(F.col("layer_r2"), 5).alias("r2"), F.col("layer_r4.status").alias("status"),
        *[r(F.col(c)).alias(c.lower()) for c in ("C1", "C2", "C3", "C4")], r(F.col("C5.degradation")).alias("c5"), F.col("layer_r3.name").alias("bottleneck"),
    )


@query(SCORED + f""", g AS (SELECT scene, count(*) AS num_records, {", ".join(f"avg({m}) AS {m}" for m in MEANS)}, sum(D6_fn_pixels) FILTER (D_gt_eligible) / sum(D6_gt_pixels) FILTER (D_gt_eligible) AS D6_image_missed_ratio FROM rec GROUP BY scene)
 SELECT scene, num_records, num_records < 30000 AS skipped, round({R1}, 5) AS r1, round({R2}, 5) AS r2 FROM g""")
def stratified_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.summary(records(spark, sf_dir), 30000, ["scene"])
    return s.select("scene", "num_records", "skipped", r(F.col("layer_r1"), 5).alias("r1"), r(F.col("layer_r2"), 5).alias("r2"))


WIDTH, HEIGHT, DELTA = 1000, 700, 0.15
_POINT = "l_quantity * 20 AS x, l_discount * 7000 AS y"


def _sides(cut: str) -> str:
    """Distances of both sides of each order, points cut by a condition."""
    return f"""p AS (SELECT l_orderkey AS ok, l_linenumber AS ln, row_number() OVER () AS id, {_POINT} FROM lineitem), q AS (SELECT * FROM p WHERE {cut}),
 d AS (SELECT a.ok, a.id, a.ln % 2 = 1 AS gt, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sqrt({WIDTH * WIDTH + HEIGHT * HEIGHT}) AS d
 FROM q a LEFT JOIN q b ON a.ok = b.ok AND a.ln % 2 <> b.ln % 2 GROUP BY a.ok, a.id, a.ln),
 s AS (SELECT o.ok, count(*) FILTER (gt) AS n_gt, count(*) FILTER (NOT gt) AS n_pred, avg((coalesce(d, 9) <= {DELTA})::INT) FILTER (gt) AS recall, avg((coalesce(d, 9) <= {DELTA})::INT) FILTER (NOT gt) AS prec,
 CASE WHEN count(*) FILTER (gt AND d IS NULL) = 0 THEN quantile_cont(d, 0.5) FILTER (gt) END AS med, CASE WHEN count(*) FILTER (gt AND d IS NULL) = 0 THEN quantile_cont(d, 0.95) FILTER (gt) END AS p95
 FROM (SELECT DISTINCT ok FROM p) o LEFT JOIN d ON o.ok = d.ok GROUP BY o.ok), f AS (SELECT *, CASE WHEN prec + recall = 0 THEN 0 ELSE 2 * prec * recall / (prec + recall) END AS f1 FROM s)"""


def point_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct((F.col("l_quantity") * 20).alias("x"), (F.col("l_discount") * 7000).alias("y"))
    sides = [F.collect_list(F.when(F.col("l_linenumber") % 2 == odd, point)).alias(name) for name, odd in (("gt", 1), ("pred", 0))]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg(*sides).withColumns({"w": F.lit(WIDTH), "h": F.lit(HEIGHT)})


@query(f"""WITH {_sides("true")} SELECT ok, n_gt::INT AS n_gt, n_pred::INT AS n_pred, round(recall, 6) AS recall, round(prec, 6) AS prec, round(f1, 6) AS f1,
 round(med, 6) AS err_median, round(p95, 6) AS err_p95, round(1 - recall, 6) AS unsupported FROM f""")
def localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.localise(point_sets(spark, sf_dir), "pred", "gt", "w", "h", DELTA)
    names = {"D3p_support_recall": "recall", "D3p_support_precision": "prec", "D3p_support_f1": "f1", "D3p_loc_err_median": "err_median", "D3p_loc_err_p95": "err_p95", "D6p_unsupported_marking_ratio": "unsupported"}
    return d.select("ok", F.col("D3p_n_gt_points").alias("n_gt"), F.col("D3p_n_pred_points").alias("n_pred"), *[r(F.col(a)).alias(b) for a, b in names.items()])


@query(f"WITH {_sides('y >= 0.40 * 700 AND y < 0.80 * 700')} SELECT ok, round(f1, 6) AS middle_f1, round(recall, 6) AS middle_recall FROM f")
def localisation_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.localise(point_sets(spark, sf_dir), "pred", "gt", "w", "h", DELTA)
    return d.select("ok", r(F.col("D4p_middle_f1")).alias("middle_f1"), r(F.col("D4p_middle_recall")).alias("middle_recall"))


@query(f"""WITH {_sides("true")} SELECT count(*) AS scored, [{DELTA}]::DOUBLE[]::VARCHAR AS deltas, round(avg(f1), 6) AS f1, round(avg(prec), 6) AS prec, round(avg(recall), 6) AS recall, round(avg(med), 6) AS err_median,
 round(avg(p95), 6) AS err_p95, round(avg(1 - recall), 6) AS unsupported FROM f""")
def localisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.summarise(L.localise(point_sets(spark, sf_dir), "pred", "gt", "w", "h", DELTA))
    names = {"D3p_support_f1": "f1", "D3p_support_precision": "prec", "D3p_support_recall": "recall", "D3p_loc_err_median": "err_median", "D3p_loc_err_p95": "err_p95", "D6p_unsupported_marking_ratio": "unsupported"}
    return s.select(F.col("D3p_num_scored").alias("scored"), F.col("D3p_deltas").cast("string").alias("deltas"), *[r(F.col(f"{a}_mean")).alias(b) for a, b in names.items()])


GRID = [0.02, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45]


@query(f"""WITH {_sides("true")}, g AS (SELECT ok, t.delta, avg((coalesce(d, 9) <= t.delta)::INT) FILTER (gt) AS rc, avg((coalesce(d, 9) <= t.delta)::INT) FILTER (NOT gt) AS pr FROM d, unnest({GRID}::DOUBLE[]) AS t(delta) GROUP BY 1, 2),
 c AS (SELECT delta, avg(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END) AS y FROM g GROUP BY 1),
 n AS (SELECT delta, (delta - min(delta) OVER ()) / (max(delta) OVER () - min(delta) OVER ()) AS u, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS v FROM c),
 e AS (SELECT arg_min(v, delta) AS v0, arg_max(v, delta) AS v1 FROM n), k AS (SELECT arg_max(delta, round(v - (v0 + u * (v1 - v0)), 9)) AS knee FROM n, e)
 SELECT knee AS delta_knee, (SELECT round(quantile_cont(d, 0.9), 6) FROM d WHERE gt AND d IS NOT NULL) AS delta_percentile, knee AS delta_selected, 'f1_knee' AS selection_rule FROM k""")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = point_sets(spark, sf_dir).withColumns({"p": L.canonical(F.col("pred"), F.col("w"), F.col("h")), "g": L.canonical(F.col("gt"), F.col("w"), F.col("h"))})
    d = d.select("ok", L.nearest(F.col("g"), F.col("p")).alias("f"), L.nearest(F.col("p"), F.col("g")).alias("b"))
    return L.select_delta(d, ["ok"], "f", "b", GRID).withColumn("delta_percentile", r(F.col("delta_percentile")))


@query("""SELECT o_orderkey AS sample_id, c_name AS name, o_totalprice AS score FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5000) JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5000).withColumnRenamed("o_custkey", "id")
    pred = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    d = J.aligned(gt, pred, "id", readable=F.col("o_orderstatus") != "P")
    return d.select(F.col("o_orderkey").alias("sample_id"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("score"))


@query("SELECT doc_id, quality IS NOT NULL AS predicted, coalesce(quality, 0) AS pixels FROM documents LEFT JOIN labels USING (doc_id)")
def paired_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = table(spark, sf_dir, "documents").select("doc_id")
    d = J.paired(gt, table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null"), "doc_id")
    return d.select("doc_id", "predicted", F.coalesce("quality", F.lit(0)).alias("pixels"))


@query("""SELECT count(*) FILTER (s_suppkey IS NOT NULL AND c_mktsegment <> 'BUILDING') AS processed, count(*) FILTER (s_suppkey IS NULL OR c_mktsegment = 'BUILDING') AS skipped
 FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def scored_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("sample_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("pred_mask"))
    gt = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("sample_id"), F.col("s_name").alias("gt_mask"))
    return J.scored_pairs(pred, gt, "pred_mask", "gt_mask")[1]


@query("""WITH i AS (SELECT o_custkey AS id, o_totalprice AS price, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
 SELECT c_custkey AS id, price AS i1_price, status AS i1_status, s_acctbal AS d_balance FROM customer LEFT JOIN i ON c_custkey = i.id AND k = 1 LEFT JOIN supplier ON c_custkey = s_suppkey""")
def combined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("id"), "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("balance"))
    return J.combined(base, {"i1": (i, "id", ["o_orderkey"])}, {"d": (d, "id")}, drop=["o_orderkey"])


@query("""SELECT c_custkey AS id, coalesce(c_mktsegment, 'x') AS name, (s_suppkey IS NOT NULL)::INT AS m_supplier, (s_suppkey IS NULL)::INT AS m_none
 FROM (SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_mktsegment END AS c_mktsegment, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)""")
def updated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("name"))
    d = J.updated(base, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name")), "id", ["name"])
    d = d.withColumn("m", F.when(F.col("updated"), "Supplier")).drop("updated")
    return J.numeric_only(J.one_hot_group(d, "m", ["supplier", "none"], "none"), ["name"])


VERDICTS = """WITH t AS (SELECT user_id, event_type AS dim, list(DISTINCT floor(value / 20)::INT::VARCHAR) FILTER (event_id % 2 = 0) AS a, list(DISTINCT floor(value / 20)::INT::VARCHAR) FILTER (event_id % 2 = 1 AND user_id % 7 <> 0) AS b FROM events GROUP BY 1, 2),
 v AS (SELECT dim, a, coalesce(b, []) AS b FROM t WHERE a IS NOT NULL AND user_id % 5 <> 0), c AS (SELECT dim, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, len(b) AS got, len(a) AS want FROM v),
 s AS (SELECT dim, count(*) AS n, avg((i = u)::INT) AS exact, avg(i / u) AS jaccard, sum(i) AS tp, sum(got - i) AS fp, sum(want - i) AS fn FROM c GROUP BY ROLLUP (dim)),
 e AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s) """


@query(VERDICTS + """SELECT dim, n, round(exact, 6) AS exact, round(jaccard, 6) AS jaccard, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM e""")
def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.floor(F.col("value") / 20).cast("int").cast("string")
    own = lambda keep: F.collect_set(F.when(keep, tag))
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("dim")).agg(own(F.col("event_id") % 2 == 0).alias("a"), own((F.col("event_id") % 2 == 1) & (F.col("user_id") % 7 != 0)).alias("b"))
    truth = d.select("user_id", "dim", F.when(F.size("a") > 0, F.col("a")).alias("truth"), (F.col("user_id") % 5 == 0).alias("unsure"))
    scores = J.tag_scores(J.verdicts(truth, d.where(F.size("b") > 0).select("user_id", "dim", "b"), ["user_id", "dim"], "truth", "b"), ["dim"], "truth", "b")
    return scores.select("dim", "n", *[r(F.col(c)).alias(c) for c in ("exact", "jaccard", "precision", "recall", "f1")], "tp", "fp", "fn")


@query("""WITH d AS (SELECT c_custkey, c_name || '_' || n_name || '_0' AS id FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT id AS sample_id, c_custkey AS tagged_c_custkey, c_custkey * 2 AS c FROM d WHERE c_custkey % 3 <> 0""")
def tagged_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [F.col("c_name"), F.col("n_name"), F.lit("0")]
    standard = d.where("c_custkey % 3 <> 0").select(F.concat_ws("_", *parts).alias("sample_id"), (F.col("c_custkey") * 2).alias("c"))
    return J.subset(d, standard, parts, meta=["c_custkey"])[0]


@query("""SELECT a.k AS k, a.q AS a_score, b.q AS b_score FROM (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 45) a
 JOIN (SELECT l_orderkey AS k, max(l_discount) AS q FROM lineitem GROUP BY 1 HAVING max(l_discount) > 0.08) b ON a.k = b.k""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return J.side_by_side({"a": d.where("q > 45").select("k", F.col("q").alias("score")), "b": d.where("d > 0.08").select("k", F.col("d").alias("score"))}, "k", ["score"])


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer), b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS position FROM customer)
 SELECT position, c_custkey, c_name FROM a JOIN b USING (position)""")
def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer")
    names = d.select("c_name", (-F.col("c_custkey")).alias("back"))
    return J.positional(d.select("c_custkey", "c_acctbal"), names, ["c_acctbal", "c_custkey"], ["back"]).select("position", "c_custkey", "c_name")


@query("""SELECT p_partkey AS id, p_name AS name, NULL AS balance FROM part UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT p_partkey FROM part)""")
def stacked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return J.stacked(n, s.join(J.common(n, s, key="id"), "id", "left_semi"))


FRAMES = "WITH f AS (SELECT o_orderkey AS k, nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'clear' END, '') AS w0, CASE o_orderpriority WHEN '1-URGENT' THEN 'curve' WHEN '2-HIGH' THEN 'wet' END AS condition, CASE o_custkey % 3 WHEN 0 THEN 'highway' WHEN 1 THEN 'urban' ELSE 'city street' END AS scene, o_custkey % 5 AS lanes, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 40) / 100 END AS dark FROM orders) "


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "P", "").otherwise("clear").alias("own"), F.lit("fog").alias("target"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "curve").when(F.col("o_orderpriority") == "2-HIGH", "wet").alias("condition"),
        F.when(c % 3 == 0, "highway").when(c % 3 == 1, "urban").otherwise("city street").alias("scene"), (c % 5).alias("lanes"), F.when(c % 4 > 0, (c % 40) / 100).alias("dark"),
    )


@query(FRAMES + """SELECT k, coalesce(w0, 'fog') AS weather, CASE WHEN condition = 'curve' THEN 'curve' WHEN scene = 'highway' AND lanes <= 2 THEN 'rural_highway' WHEN scene <> 'highway' AND lanes BETWEEN 2 AND 3 THEN 'urban_street'
 WHEN scene <> 'highway' AND lanes > 3 THEN 'urban_intersection' ELSE condition END AS context, CASE WHEN dark > 0.30 THEN 'high' WHEN dark > 0.15 THEN 'medium' WHEN dark IS NOT NULL THEN 'low' ELSE 'unknown' END AS traffic,
 coalesce(condition, scene) AS stratum FROM f""")
def frame_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    metadata = F.create_map(F.lit("condition"), F.coalesce("condition", F.lit("")), F.lit("scene"), F.col("scene"))
    return f.select("k", E.either(F.col("own"), F.col("target")).alias("weather"), E.context(F.col("condition"), F.col("scene"), F.col("lanes")).alias("context"), E.traffic(F.lit(None).cast("string"), F.col("dark")).alias("traffic"), E.stratum(metadata, "context").alias("stratum"))


@query("""WITH t AS (SELECT user_id, coalesce(list(DISTINCT event_type), []) AS a FROM events GROUP BY 1) SELECT user_id, len(list_intersect(a, ['click', 'error'])) > 0 AS some, len(list_intersect(a, ['click', 'error'])) = 2 AS every FROM t""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return t.select("user_id", E.has_tags(F.col("a"), ["click", "error"]).alias("some"), E.has_tags(F.col("a"), ["click", "error"], True).alias("every"))


@query("""WITH b AS (SELECT CASE WHEN contains(lower(p_type), 'brass') THEN 'clearly_visible' WHEN contains(lower(p_type), 'steel') THEN 'worn/faded' ELSE 'other' END AS bucket, p_retailprice AS v FROM part WHERE p_size <> 7),
 s AS (SELECT bucket, count(*) AS n, round_even(avg(v), 4) AS mean, round_even(quantile_cont(v, 0.5), 4) AS median, min(v) AS least, max(v) AS most FROM b GROUP BY 1)
 SELECT bucket, n, mean, median, round(least, 4) AS least, round(most, 4) AS most FROM s""")
def wear_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.replace(F.replace(F.lower("p_type"), F.lit("brass"), F.lit("Clearly Visible")), F.lit("steel"), F.lit("Low Contrast"))
    rows = table(spark, sf_dir, "part").select(named.alias("tag"), F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("I1"))
    return D.wear_summary(rows, "tag", "I1")


@query("""WITH t AS (SELECT user_id, list_sort(list(DISTINCT CASE event_type WHEN 'click' THEN 'Clearly Visible' WHEN 'error' THEN 'occluded' ELSE event_type END)) AS a FROM events GROUP BY 1)
 SELECT user_id, list_contains(a, 'Clearly Visible') AND list_contains(a, 'occluded') AS conflict,
 len(CASE WHEN list_contains(a, 'Clearly Visible') AND list_contains(a, 'occluded') THEN list_filter(a, lambda x: x <> 'Clearly Visible') ELSE a END)::INT AS kept FROM t""")
def tag_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "Clearly Visible").when(F.col("event_type") == "error", "occluded").otherwise(F.col("event_type"))
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(name).alias("a")).withColumn("u", E.unconflicted(F.col("a")))
    return t.select("user_id", (F.size("u.dropped") > 0).alias("conflict"), F.size("u.kept").alias("kept"))


@query("""WITH s AS (SELECT sum(l_quantity) AS tp, sum(l_linenumber) AS fp, sum(l_discount * 100) AS fn, count(*) AS n, avg(l_tax) AS accuracy FROM lineitem),
 e AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s) SELECT n, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(accuracy, 6) AS accuracy FROM e""")
def lane_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("missed", F.col("l_discount") * 100)
    return V.lane_totals(d, "l_quantity", "l_linenumber", "missed", "l_tax").select("n", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("""WITH g AS (SELECT l_returnflag AS model, l_linestatus AS dataset, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2), q AS (SELECT l_returnflag AS model, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1)
 SELECT model, count(*) AS datasets, round(avg(m), 8) AS mean_of_means, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3 FROM g JOIN q USING (model) GROUP BY model""")
def figure_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by model and dataset, the mean of those by model, and the quartiles of all images."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("dataset"), "l_discount", "l_quantity")
    found = V.rollup(d, "model", "dataset", "l_discount", "l_quantity")
    return found.select("model", F.col("groups").alias("datasets"), r(F.col("mean_of_means"), 8).alias("mean_of_means"), *[F.col(f"q{k}").alias(f"q{k + 1}") for k in range(3)])


@query("SELECT count(*) AS samples, count(*) FILTER (quality IS NOT NULL) AS found, count(*) FILTER (quality IS NULL) AS missing, array_to_string(list_sort(list(DISTINCT source)), ',') AS datasets FROM documents LEFT JOIN labels USING (doc_id)")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.paired(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    names = F.array_join(F.array_sort(F.collect_set("source")), ",")  # sources of manifests are few
    return d.agg(F.count("*").alias("samples"), F.count("quality").alias("found"), F.count_if(F.col("quality").isNull()).alias("missing"), names.alias("datasets"))


@query("SELECT o_orderpriority AS outcome, arg_min(o_orderkey, {c: o_totalprice, k: o_orderkey}) AS best_run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs that can be compared (same outcome, finished) the one of the least loss."""
    d = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "outcome")
    return V.best(d, ["outcome"], "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('17:' || o_orderkey::VARCHAR) LIMIT 200")
def seeded_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of fixed size: the least seeded hashes."""
    return V.seeded(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200, "17")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^a-z]', '/', 'g'), '/', '_', 'g') AS safe, lower(regexp_replace(regexp_replace(trim(p_type), '\\s*/\\s*', ' / ', 'g'), '\\s+', ' ', 'g')) AS tag,
 'tag_' || replace(lower(p_brand), ' ', '_') AS dimension FROM part""")
def names_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", E.safe_name(F.regexp_replace("p_name", "[^a-z]", "/")).alias("safe"), E.normal_tag(F.col("p_type")).alias("tag"), E.dimension_column(F.col("p_brand")).alias("dimension"))
