"""Smoothing, width courses and paint patterns along lanes, with their SQL. A lane is an
embedding: 64 values, one a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from .metric_queries import Query, r
from .model_queries import lane_samples

PROFILE_QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        PROFILE_QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda z, i: z + CASE WHEN i = 10 + vec_id % 40 THEN 5 ELSE 0 END) AS x FROM embeddings),
 m AS (SELECT vec_id, x, list_transform(range(1, 65), lambda i: list_median(list_transform(range(i - 4, i + 5), lambda j: x[greatest(1, least(64, j))]))) AS m FROM v),
 o AS (SELECT *, list_transform(range(1, 65), lambda i: x[i] - m[i]) AS o FROM m), c AS (SELECT *, list_median(o) AS c FROM o),
 d AS (SELECT *, greatest(7 * 1.4826 * list_median(list_transform(o, lambda z: abs(z - c))), 0.4) AS far FROM c),
 k AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN abs(o[i]) > far THEN m[i] ELSE x[i] END) AS y, len(list_filter(o, lambda z: abs(z) > far)) AS spikes FROM d),
 s AS (SELECT vec_id, spikes, list_transform(range(6, 60), lambda i: list_dot_product(y[i - 5:i + 5], [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]::DOUBLE[]) / 429) AS s FROM k)
 SELECT vec_id, spikes::INT AS spikes, round(list_sum(list_transform(s, lambda z, i: z * i)), 5) AS moment, round(list_max(s), 6) AS most FROM s""")
def smoothed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with one spike each, smoothed; sums of all samples but those at both ends."""
    spiked = F.transform("x", lambda z, i: z + F.when(i == 9 + F.col("vec_id") % 40, 5.0).otherwise(0.0))
    rows = F.sequence(F.lit(0), F.lit(63)).cast("array<double>")
    d = frames.smoothed_lines(lane_samples(spark, sf_dir).select("vec_id", rows.alias("rows"), spiked.alias("x")), "rows", "x", 0.1)
    middle = F.slice("smooth_across", 6, 54)
    moment = F.aggregate(F.transform(middle, lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z)
    return d.select("vec_id", "spikes", r(moment, 5).alias("moment"), r(F.array_max(middle)).alias("most"))


#: Least squares by residuals: the bend's column less its part of the line.
@query("""WITH e AS (SELECT vec_id, i, (i - 1) / 63 AS t, 20 + x + CASE vec_id % 3 WHEN 1 THEN 0.1 * i WHEN 2 THEN 0.2 * greatest(i - 32, 0) ELSE 0 END AS y
 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 g AS (SELECT vec_id, avg(y) AS m, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM e GROUP BY 1),
 l AS (SELECT e.*, m, a + b * t AS line FROM e JOIN g USING (vec_id)),
 h AS (SELECT c, i, greatest(t - c, 0) AS h, greatest(t - c, 0) - regr_intercept(greatest(t - c, 0), t) OVER w - regr_slope(greatest(t - c, 0), t) OVER w * t AS hr
 FROM (SELECT i, (i - 1) / 63 AS t FROM range(1, 65) x(i)), (SELECT 0.24 + k * 0.52 / 14 AS c FROM range(15) y(k)) WINDOW w AS (PARTITION BY c)),
 p AS (SELECT vec_id, c, sum((y - line) * hr) / sum(hr * hr) AS k FROM l JOIN h USING (i) GROUP BY 1, 2),
 f AS (SELECT l.vec_id, 'piecewise_transition' AS course, 4 AS parts, c, i, y, line + k * hr AS f FROM l JOIN p ON l.vec_id = p.vec_id JOIN h USING (c, i)
 UNION ALL SELECT vec_id, 'constant', 1, NULL, i, y, m FROM l UNION ALL SELECT vec_id, 'linear_taper', 2, NULL, i, y, line FROM l),
 s AS (SELECT vec_id, course, c, 64 * ln(greatest(avg(((y - f) / f) ** 2), 1e-12)) + parts * ln(64) AS bic, median(f) AS mid, max(f) - min(f) AS wide, abs(max(f) FILTER (i = 64) - max(f) FILTER (i = 1)) AS ends, list_sort(list(abs(y - f) / f))[58] AS high
 FROM f GROUP BY vec_id, course, c, parts),
 o AS (SELECT vec_id, min(bic) FILTER (course = 'constant') AS bic_constant, min(bic) FILTER (course = 'linear_taper') AS bic_linear, min(bic) FILTER (course = 'piecewise_transition') AS bic_bent, arg_min(c, bic) FILTER (course = 'piecewise_transition') AS place,
 arg_min(wide / mid, bic) FILTER (course = 'piecewise_transition') AS wide, max(ends / mid) FILTER (course = 'linear_taper') AS tapers, max(high) FILTER (course = 'constant') AS high0, max(high) FILTER (course = 'linear_taper') AS high1 FROM s GROUP BY 1),
 q AS (SELECT *, bic_constant - bic_linear >= 2.5 AND tapers >= 0.055 AS linear FROM o),
 z AS (SELECT *, CASE WHEN CASE WHEN linear THEN bic_linear ELSE bic_constant END - bic_bent >= 3.5 AND wide >= 0.12 AND CASE WHEN linear THEN high1 ELSE high0 END >= 0.012 THEN 'piecewise_transition' WHEN linear THEN 'linear_taper' ELSE 'constant' END AS course FROM q)
 SELECT vec_id, course, round(bic_constant, 5) AS bic_constant, round(bic_linear, 5) AS bic_linear, round(bic_bent, 5) AS bic_bent, CASE WHEN course = 'piecewise_transition' THEN round(place, 6) END AS bend FROM z""")
def lane_width_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths that stay, taper or bend, by lane; plain least squares, since no residual is far."""
    i, kind = (lambda k: k + 1), F.col("vec_id") % 3
    width = F.transform("x", lambda x, k: 20 + x + F.when(kind == 1, 0.1 * i(k)).when(kind == 2, 0.2 * F.greatest(i(k) - 32, F.lit(0))).otherwise(0.0))
    rows = F.sequence(F.lit(0), F.lit(63)).cast("array<double>")
    d = frames.width_courses(lane_samples(spark, sf_dir).select("vec_id", rows.alias("rows"), width.alias("widths")), "rows", "widths", full=1e9)
    return d.select("vec_id", "course", *[r(F.col(c), 5).alias(c) for c in ("bic_constant", "bic_linear", "bic_bent")], r(F.col("bend")).alias("bend"))


@query("""WITH e AS (SELECT vec_id, i - 1 AS i, (i - 1) * 1.5::DOUBLE AS s, greatest(0::DOUBLE, least(1::DOUBLE, 0.15::DOUBLE + 0.6::DOUBLE * ((i - 1) % (8 + vec_id % 5) < 3 + vec_id % 3)::INT + 0.5::DOUBLE * x)) AS p, least(1::DOUBLE, 0.2::DOUBLE + 4 * abs(x)) AS q
 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 lv AS (SELECT vec_id, round_even(p * 255, 0) AS l, count(*) AS n FROM e WHERE q >= 0.22 GROUP BY 1, 2),
 cu AS (SELECT vec_id, l, sum(n) OVER w AS n0, sum(n * l) OVER w AS s0, sum(n) OVER (PARTITION BY vec_id) AS n, sum(n * l) OVER (PARTITION BY vec_id) AS s FROM lv WINDOW w AS (PARTITION BY vec_id ORDER BY l)),
 ot AS (SELECT vec_id, l, row_number() OVER (PARTITION BY vec_id ORDER BY round((s / n * n0 / n - s0 / n) ** 2 / (n0 / n * (1 - n0 / n)), 9) DESC, l) AS k FROM cu WHERE n0 < n),
 ra AS (SELECT vec_id, max(p) - min(p) AS far FROM e WHERE q >= 0.22 GROUP BY 1),
 ct AS (SELECT ra.vec_id, CASE WHEN far < 0.06 OR l IS NULL THEN 0.44 ELSE least(0.62, greatest(0.3, l / 255)) END AS cut FROM ra LEFT JOIN ot ON ra.vec_id = ot.vec_id AND k = 1),
 c AS (SELECT e.*, cut, (p >= cut)::INT AS on_, CASE WHEN q >= 0.22 THEN (p >= cut)::INT ELSE -1 END AS code FROM e JOIN ct USING (vec_id)),
 b AS (SELECT *, coalesce(code <> lag(code) OVER w, true) AS begins FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
 rn AS (SELECT vec_id, code, greatest(coalesce(lead(s) OVER (PARTITION BY vec_id ORDER BY i), 94.5) - s, 1e-8) AS long FROM b WHERE begins),
 st AS (SELECT vec_id, count(*) FILTER (code = 1) AS runs, count(*) FILTER (code = 0) AS gaps, avg(long) FILTER (code = 1) AS mean_run, median(long) FILTER (code = 1) AS median_run, stddev_pop(long) FILTER (code = 0) / avg(long) FILTER (code = 0) AS gap_cv FROM rn GROUP BY 1),
 av AS (SELECT vec_id, min(cut) AS cut, sum(p * q) / sum(q) AS evidence_mean, sum(on_ * q) / sum(q) AS on_share, sum(q) AS total, max(s) FILTER (q >= 0.22) - min(s) FILTER (q >= 0.22) AS reach FROM c GROUP BY 1),
 bo AS (SELECT av.*, st.* EXCLUDE (vec_id), greatest(10.5, reach / 12) AS lo, reach / 2.85 AS hi FROM av JOIN st USING (vec_id)),
 pe AS (SELECT vec_id, total, median_run, lo + (hi - lo) * k / 33 AS period FROM bo, range(34) x(k) WHERE hi > lo),
 du AS (SELECT *, greatest(0.16, mid - 0.05) AS d0, least(0.78, mid + 0.05) AS d1 FROM (SELECT *, least(0.78, greatest(0.16, median_run / period)) AS mid FROM pe)),
 ph AS (SELECT du.*, turn, c.p, c.q, (c.s - turn / 24 * period) - floor((c.s - turn / 24 * period) / period) * period AS place FROM du JOIN c USING (vec_id), range(24) y(turn)),
 sc AS (SELECT vec_id, period, turn, k, 1 - sum(q * CASE WHEN place < (d0 + (d1 - d0) * k / 6) * period THEN abs(p - 1) ELSE p END) / min(total) AS score FROM ph, range(7) z(k) GROUP BY 1, 2, 3, 4),
 be AS (SELECT vec_id, max(score) AS dashed_score FROM sc GROUP BY 1)
 SELECT bo.vec_id, round(cut, 6) AS cut, runs::INT AS runs, gaps::INT AS gaps, round(mean_run, 6) AS mean_run, round(median_run, 6) AS median_run, round(gap_cv, 6) AS gap_cv, round(evidence_mean, 6) AS evidence_mean, round(on_share, 6) AS on_share, round(dashed_score, 6) AS dashed_score FROM bo LEFT JOIN be USING (vec_id)""")
def lane_paint_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of paint in dashes, with noise: cut, runs, and the best template's score."""
    k = F.col("vec_id")
    p = F.transform("x", lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.15 + 0.6 * (i % (8 + k % 5) < 3 + k % 3).cast("int") + 0.5 * x)))
    q = F.transform("x", lambda x: F.least(F.lit(1.0), 0.2 + 4 * F.abs(x)))
    s = F.transform("x", lambda x, i: i * F.lit(1.5))
    d = frames.paint_patterns(lane_samples(spark, sf_dir).select("vec_id", p.alias("p"), q.alias("q"), s.alias("s")), "p", "q", "s")
    return d.select("vec_id", "runs", "gaps", *[r(F.col(c)).alias(c) for c in ("cut", "mean_run", "median_run", "gap_cv", "evidence_mean", "on_share", "dashed_score")])


#: Weighted least squares by residuals, as above; reversals sample by sample.
@query("""WITH RECURSIVE a AS (SELECT vec_id, i, x AS k, least(1::DOUBLE, 6 * abs(y)) AS w FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 v AS (SELECT vec_id, i - 1 AS s, k, w, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS j FROM a WHERE w >= 0.08),
 b AS (SELECT vec_id, count(*) AS n, min(s) AS s0, max(s) AS s1, sum(w) AS sw, max(w) AS mw, greatest(sum(w) / max(w), 2) AS ne FROM v GROUP BY 1 HAVING count(*) >= 8),
 d AS (SELECT x.vec_id, abs(z.k - y.k) / (z.s - y.s) AS g, x.w FROM v x JOIN v y ON x.vec_id = y.vec_id AND y.j = x.j - 5 JOIN v z ON x.vec_id = z.vec_id AND z.j = x.j + 5),
 gv AS (SELECT vec_id, sum(g * w) / sum(w) AS variation FROM d GROUP BY 1),
 q AS (SELECT vec_id, abs(k) AS k, sum(w) OVER (PARTITION BY vec_id ORDER BY abs(k), s) AS reach, sum(w) OVER (PARTITION BY vec_id) AS total FROM v), p AS (SELECT vec_id, min(k) AS p95 FROM q WHERE reach >= 0.95 * total GROUP BY 1),
 hd AS (SELECT vec_id, sum(t) AS heading FROM (SELECT vec_id, (abs(k) + abs(lag(k) OVER o)) / 2 * (s - lag(s) OVER o) AS t FROM v WINDOW o AS (PARTITION BY vec_id ORDER BY s)) GROUP BY 1),
 strong AS (SELECT v.vec_id, s, sign(k)::INT AS sg, 0.08 * (s1 - s0) AS apart, row_number() OVER (PARTITION BY v.vec_id ORDER BY s) AS j FROM v JOIN b ON v.vec_id = b.vec_id WHERE abs(k) >= 0.45::DOUBLE * 0.2::DOUBLE),
 rv AS (SELECT vec_id, j, sg, s AS was, 0 AS c FROM strong WHERE j = 1 UNION ALL SELECT t.vec_id, t.j, CASE WHEN t.sg <> rv.sg AND t.s - was >= apart THEN t.sg ELSE rv.sg END, CASE WHEN t.sg <> rv.sg AND t.s - was >= apart THEN t.s ELSE was END, c + (t.sg <> rv.sg AND t.s - was >= apart)::INT FROM rv JOIN strong t ON t.vec_id = rv.vec_id AND t.j = rv.j + 1),
 rc AS (SELECT vec_id, max(c) AS turns FROM rv GROUP BY 1),
 e AS (SELECT v.*, (s - s0) / (s1 - s0) AS t, ne, sw, n FROM v JOIN b USING (vec_id)),
 m AS (SELECT vec_id, sum(w * t) / sum(w) AS tm, sum(w * k) / sum(w) AS km, sum(w * t * k) / sum(w) AS tk, sum(w * t * t) / sum(w) AS tt FROM e GROUP BY 1),
 l AS (SELECT e.*, km, tm, tt, k - km - (tk - tm * km) / (tt - tm * tm) * (t - tm) AS kr FROM e JOIN m USING (vec_id)),
 hm AS (SELECT vec_id, c, any_value(n) AS n, count(*) FILTER (t <= c) AS left_n, sum(w * greatest(t - c, 0)) / sum(w) AS hm, sum(w * t * greatest(t - c, 0)) / sum(w) AS th FROM l, (SELECT 0.22::DOUBLE + x * 0.056::DOUBLE AS c FROM range(11) y(x)) GROUP BY 1, 2),
 hr AS (SELECT l.vec_id, c, w, kr, greatest(t - c, 0) - hm - (th - tm * hm) / (tt - tm * tm) * (t - tm) AS hr FROM l JOIN hm USING (vec_id) WHERE least(left_n, l.n - left_n) >= greatest(4, floor(0.18 * l.n))),
 pb AS (SELECT vec_id, c, sum(w * kr * kr) - sum(w * kr * hr) ** 2 / sum(w * hr * hr) AS sse FROM hr GROUP BY 1, 2), pm AS (SELECT vec_id, min(sse) AS sse FROM pb GROUP BY 1),
 o AS (SELECT vec_id, sum(w * abs(k)) / sum(w) AS bendiness, sqrt(sum(w * k * k) / sum(w)) AS rms, sqrt(sum(w * (k - km) ** 2) / sum(w)) AS std, min(ne) AS ne, min(sw) AS sw, sum(w * k * k) AS s0, sum(w * (k - km) ** 2) AS s1, sum(w * kr * kr) AS s2 FROM l GROUP BY 1)
 SELECT o.vec_id, round(bendiness, 6) AS bendiness, round(p95, 6) AS p95_curvature, round(variation, 6) AS curvature_variation, round(heading, 6) AS heading_change, round(rms, 6) AS curvature_rms, round(std, 6) AS curvature_std, coalesce(turns, 0)::INT AS reversal_count,
 round(ne * ln(s0 / sw), 5) AS bic_straight, round(ne * ln(s1 / sw) + ln(ne), 5) AS bic_constant, round(ne * ln(s2 / sw) + 2 * ln(ne), 5) AS bic_linear, round(ne * ln(pm.sse / sw) + 4 * ln(ne), 5) AS bic_bent
 FROM o JOIN p USING (vec_id) JOIN hd USING (vec_id) JOIN gv USING (vec_id) LEFT JOIN rc USING (vec_id) LEFT JOIN pm USING (vec_id)""")
def lane_curvature_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as curvature, the reversed ones as weights: diagnostics and the scores of kinds."""
    rows = F.sequence(F.lit(0), F.lit(63)).cast("array<double>")
    weight = F.transform(F.reverse("x"), lambda y: F.least(F.lit(1.0), 6 * F.abs(y)))
    d = frames.curvature_courses(lane_samples(spark, sf_dir).select("vec_id", rows.alias("s"), F.col("x").alias("k"), weight.alias("w")), "s", "k", "w", 0.2, 5)
    sums = [r(F.col(c)).alias(c) for c in ("bendiness", "p95_curvature", "curvature_variation", "heading_change", "curvature_rms", "curvature_std")]
    return d.where("bendiness is not null").select("vec_id", *sums, "reversal_count", *[r(F.col(f"bic_{c}"), 5).alias(f"bic_{c}") for c in ("straight", "constant", "linear", "bent")])


@query("""SELECT vec_id, 1 AS valid_lane_count, 1 AS unknown_lane_count, 0.1 * (2 + vec_id % 5) AS bendiness, 0.0::DOUBLE AS curvature_std, 'constant_curve' AS kind FROM embeddings""")
def lane_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arc of known radius and a lane of two points in each image: the curvature of an arc
    is one over its radius, in parts of the scale."""
    scale = 100.0
    radius = scale / (0.1 * (2 + F.col("vec_id") % 5))
    turn = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: i * F.lit(2.0) / radius)
    arc = F.transform(turn, lambda a: F.array(radius * F.cos(a), radius * F.sin(a) + 500))
    short = F.slice(arc, 1, 2)
    d = lane_samples(spark, sf_dir).select("vec_id", F.array(arc, short).alias("lanes"), F.lit(600).alias("height"), F.lit(800).alias("width"), F.lit(scale).alias("scale"))
    got = frames.alignments(d, "lanes", "height", "width", "lane_width_normalized", "scale")
    one = F.col("lanes_told")[0]
    return got.select("vec_id", "valid_lane_count", "unknown_lane_count", F.round(one["bendiness"], 3).alias("bendiness"), F.round(F.abs(one["curvature_std"]), 3).alias("curvature_std"), one["kind"].alias("kind"))
