"""Modelling, curve and point-set operators on the driver's tables, with their SQL."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import evaluation, folds, localization, models, readiness, sampling
from ..streaming.ingest import windowed_counts
from .metric_queries import Query, r, table

MODEL_QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        MODEL_QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _case(c: str) -> str:
    return f"""CASE WHEN count(DISTINCT {c}) = 2 THEN 'binomial' WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'fractional'
 WHEN min({c}) >= 0 AND count(*) FILTER ({c} <> floor({c})) = 0 THEN CASE WHEN var_samp({c}) > 1.25 * avg({c}) THEN 'negative_binomial' ELSE 'poisson' END ELSE 'ols' END"""


@query(f"""SELECT {_case("l_discount")} AS discount, {_case("l_linenumber")} AS line, {_case("l_quantity")} AS quantity, {_case("l_extendedprice")} AS price,
 {_case("CASE WHEN l_returnflag = 'R' THEN 7 ELSE 3 END")} AS returned, 'binomial' AS status FROM lineitem""")
def model_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    columns = {"discount": F.col("l_discount"), "line": F.col("l_linenumber"), "quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "returned": F.when(F.col("l_returnflag") == "R", 7).otherwise(3), "status": F.col("l_linestatus")}
    return models.recommend(d, columns)


@query("""WITH d AS (SELECT l_linenumber AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), s AS (SELECT covar_pop(x1, y) AS a, covar_pop(x2, y) AS b, var_pop(x1) AS p, var_pop(x2) AS q, covar_pop(x1, x2) AS r, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(y) AS v, count(*) AS n FROM d),
 c AS (SELECT *, (a * q - b * r) / (p * q - r * r) AS c1, (b * p - a * r) / (p * q - r * r) AS c2 FROM s), e AS (SELECT *, v - c1 * a - c2 * b AS mse FROM c)
 SELECT n AS observations, round(ln(2 * pi() * mse), 6) AS log_mse, round((n * (ln(2 * pi() * mse) + 1) + 6) / n, 6) AS aic_per_row, round(1 - mse / v, 6) AS r2, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM e""")
def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"))
    fit = models.ols(d, "y", ["x1", "x2"])
    q = models.quality(d, fit, "y")
    n = q["observations"]
    row = (n, round(math.log(2 * math.pi * q["RMSE"] ** 2), 6), round(q["AIC"] / n, 6), round(q["R_squared"], 6), round(float(fit.coef[1]), 6), round(float(fit.coef[2]), 6))
    return spark.createDataFrame([row], "observations long, log_mse double, aic_per_row double, r2 double, c1 double, c2 double")


@query("""SELECT event_id, (k = 1)::INT AS flag, round(value * k, 6) AS product, round((value + k) / 2, 6) AS mean, round(value - k, 6) AS difference, CASE WHEN k <> 0 THEN round(value / k, 6) END AS ratio, (value >= 50)::INT AS high, (value >= 50 AND k >= 50)::INT AS both_
 FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    specs = [("flag", "or", ["k"]), ("product", "product", ["value", "k"]), ("mean", "mean", ["value", "k"]), ("difference", "difference", ["value", "k"]), ("ratio", "ratio", ["value", "k"]), ("high", "threshold", ["value"]), ("large", "threshold", ["k"]), ("both_", "and", ["high", "large"])]
    made, errors = models.derive(d, [{"name": n, "operation": o, "columns": c, "value": 50} for n, o, c in specs])
    assert not errors
    return made.select("event_id", "flag", *[r(F.col(c)).alias(c) for c in ("product", "mean", "difference", "ratio")], "high", "both_")


@query("""WITH d AS (SELECT l_quantity / 51 AS y, l_discount AS x FROM lineitem WHERE l_returnflag = 'N'), s AS (SELECT regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(*) AS n FROM d) SELECT n, round(slope, 6) AS slope, round(r2, 8) AS r2 FROM s""")
def adjusted_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 51).alias("D3_f1"), F.col("l_discount").alias("I5"), F.lit("a").alias("dataset"), F.lit("b").alias("model_name"), F.col("l_returnflag").alias("space"))
    found = models.adjusted_regression(d.where("space = 'N'"), x="I5", others=(), space="space")
    return spark.createDataFrame([(found["n"], round(found["coefficients"]["I5"], 6), round(found["r_squared"], 8))], "n long, slope double, r2 double")


@query("""SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coef FROM lineitem
 UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return models.coefficients(d, models.ols(d, "l_extendedprice", ["l_quantity"])).select("term", r(F.col("coef"), 4).alias("coef"))


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_tax * l_tax) AS b, sum(l_quantity * l_tax) AS c FROM lineitem)
 SELECT unnest(['l_quantity', 'l_tax']) AS term, round(1 / (1 - c * c / (a * b)), 5) AS vif FROM s""")
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.vif(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"), ["l_quantity", "l_tax"]).select("term", r(F.col("vif"), 5).alias("vif"))


@query("""SELECT l_returnflag AS flag, round(sqrt(avg((l_discount - l_tax) ** 2)), 6) AS rmse, round(avg(abs(l_discount - l_tax)), 6) AS mae,
 round(1 - sum((l_discount - l_tax) ** 2) / (var_pop(l_discount) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""")
def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*models.fit_statistics(F.col("l_discount"), F.col("l_tax")))
    return d.select("flag", *[r(F.col(c)).alias(c) for c in ("rmse", "mae", "r2")])


@query("""WITH d AS (SELECT l_returnflag = 'R' AS y, l_quantity / 50 AS p FROM lineitem), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM d)
 SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auc FROM k""")
def area_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return models.auc(d, "y", "p").select(r(F.col("auc")).alias("auc"))


@query("""WITH c AS (SELECT l_returnflag AS g, l_linenumber AS x, sum(l_discount) AS y FROM lineitem GROUP BY 1, 2),
 n AS (SELECT g, x, (x - min(x) OVER w) / nullif((max(x) OVER w - min(x) OVER w)::DOUBLE, 0) AS u, (y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) AS v FROM c WINDOW w AS (PARTITION BY g)),
 k AS (SELECT g, x, v - (first(v ORDER BY x) OVER (PARTITION BY g) + u * (last(v ORDER BY x) OVER (PARTITION BY g) - first(v ORDER BY x) OVER (PARTITION BY g))) AS gap FROM n)
 SELECT g, x AS knee FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(gap, 9) DESC, x) AS k FROM k) WHERE k = 1""")
def knee_of_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("x")).agg(F.sum("l_discount").alias("y"))
    return localization.knee(c, ["g"], "x", "y").select("g", F.col("knee").cast("int").alias("knee"))


@query("""WITH p AS (SELECT row_number() OVER () AS id, l_orderkey AS k, l_linenumber AS n, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
 d AS (SELECT a.k, a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a LEFT JOIN p b ON a.k = b.k AND b.n % 2 = 0 WHERE a.n % 2 = 1 GROUP BY 1, 2)
 SELECT k, count(*) AS n, round(avg(d), 6) AS mean, count(*) FILTER (d <= 5) AS near FROM d GROUP BY 1""")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point of one set to the nearest of the other, within an order (an
    image): nested points, no join. Without other points a distance is infinite."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    sets = p.groupBy("k").agg(*[F.collect_list(F.when(F.col("n") % 2 == odd, F.struct("x", "y"))).alias(name) for name, odd in (("a", 1), ("b", 0))])
    apart = F.transform("a", lambda q: F.coalesce(F.array_min(F.transform("b", lambda o: F.sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)))), F.lit(float("inf"))))
    d = sets.where(F.size("a") > 0).select("k", apart.alias("d")).withColumn("finite", F.filter("d", lambda v: v < float("inf")))
    mean = F.try_divide(F.aggregate("finite", F.lit(0.0), lambda s, v: s + v), F.size("finite"))
    return d.select("k", F.size("d").cast("long").alias("n"), r(mean).alias("mean"), F.size(F.filter("d", lambda v: v <= 5)).cast("long").alias("near"))


@query("""WITH s AS (SELECT user_id AS k, event_id AS n, (value > 50)::INT AS on_ FROM events),
 d AS (SELECT k, n, on_, max(on_) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM s)
 SELECT k, n, on_, min(wide) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS closed FROM d""")
def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation, then erosion, of a sequence of states; beyond the ends nothing counts."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("n"), (F.col("value") > 50).cast("int").alias("on_"))
    return evaluation.closed(s, ["k"], ["n"], "on_").drop("wide")


@query("""SELECT g, x AS threshold, round(f, 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(f, 9) DESC, x) AS k
 FROM (SELECT l_returnflag AS g, l_quantity AS x, avg(l_discount) AS f FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("f"))
    return localization.operating_point(c, ["g"], "x", "f").select("g", "threshold", r(F.col("score")).alias("best"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


LANES = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings)"


def lane_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane is an embedding: its 64 values, one for each row of a grid."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


_CHANGED = "abs(x) >= 0.1 AND (sg = 0 OR (sign(x) <> sg AND e.i - was >= 0.05 * (n - 1)))"


@query(f"""WITH RECURSIVE {LANES}, s AS (SELECT vec_id, i, CASE WHEN abs(x) >= 0.1 THEN sign(x)::INT ELSE 0 END AS sg, i AS was, 0 AS c FROM e WHERE i = 1
 UNION ALL SELECT e.vec_id, e.i, CASE WHEN {_CHANGED} THEN sign(x)::INT ELSE sg END, CASE WHEN {_CHANGED} THEN e.i ELSE was END, c + CASE WHEN {_CHANGED} AND sg <> 0 THEN 1 ELSE 0 END
 FROM s JOIN e ON e.vec_id = s.vec_id AND e.i = s.i + 1) SELECT vec_id, max(c)::BIGINT AS reversals FROM s GROUP BY 1""")
def lane_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lane_samples(spark, sf_dir).select("vec_id", E.reversals(F.col("x"), 0.1, 0.05).cast("long").alias("reversals"))


@query(f"""WITH {LANES}, p AS (SELECT a.vec_id, a.x AS a, b.x AS b, abs(a.x) * abs(b.x) AS w FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i = a.i + 8),
 m AS (SELECT vec_id, sum(w) AS w, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * b) AS ab, sum(w * a * a) AS aa, sum(w * b * b) AS bb FROM p GROUP BY 1)
 SELECT vec_id, round(greatest(0, least(1, (ab - a * b / w) / sqrt((aa - a * a / w) * (bb - b * b / w)))), 6) AS periodicity FROM m""")
def lane_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return lane_samples(spark, sf_dir).select("vec_id", r(E.autocorrelation(x, F.transform(x, F.abs), 8)).alias("periodicity"))


@query(f"""WITH {LANES}, d AS (SELECT vec_id, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM e)
 SELECT vec_id, round(sum(sqrt(d * d + 1)), 6) AS length FROM d WHERE d IS NOT NULL GROUP BY 1""")
def lane_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform("x", lambda _, i: i.cast("double"))
    return lane_samples(spark, sf_dir).select("vec_id", r(E.arc_length(F.col("x"), rows)).alias("length"))


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, (l_orderkey % 5)::INT AS f FROM lineitem),
 c AS (SELECT g.f, regr_slope(y, x) AS s, regr_intercept(y, x) AS b FROM (SELECT DISTINCT f FROM d) g JOIN d ON d.f <> g.f GROUP BY g.f)
 SELECT f AS fold, count(*) AS n, round(sqrt(avg((y - b - s * x) ** 2)), 3) AS rmse, round(avg(abs(y - b - s * x)), 3) AS mae FROM d JOIN c USING (f) GROUP BY 1""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    found = models.cross_validate(d, "l_extendedprice", ["l_quantity"], F.col("l_orderkey") % 5)
    return found.select("fold", "n", r(F.col("rmse"), 3).alias("rmse"), r(F.col("mae"), 3).alias("mae"))


TAGS = ("click", "error", "purchase", "signup", "view")
_OVER = "OVER (ORDER BY day)"


@query(f"""WITH d AS (SELECT ts::DATE AS day, count(*) AS n, {", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TAGS)} FROM events GROUP BY 1),
 s AS (SELECT day, sum(n) {_OVER} AS n, {", ".join(f"sum({t}) {_OVER} AS c_{t}, {t} > 0 AND sum({t}) {_OVER} - {t} < 150 AS g_{t}" for t in TAGS)} FROM d),
 p AS (SELECT *, coalesce(max(CASE WHEN {" OR ".join(f"g_{t}" for t in TAGS)} THEN n END) {_OVER}, 0) AS was, max(n) OVER () - n AS rest FROM s)
 SELECT day, n::BIGINT AS n, CASE WHEN n >= 500 AND least({", ".join(f"c_{t}" for t in TAGS)}) >= 150 THEN 'coverage' WHEN n >= 500 AND n - was >= 300 THEN 'stalled' WHEN n >= 5000 THEN 'cap'
 WHEN rest <= 0 THEN 'pool_exhausted' END AS reason FROM p""")
def sampling_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags seen by the end of each day and whether sampling would end there. Running
    counts go over one row a day, summed before."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"))
    d = days.agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == t).alias(t) for t in TAGS])
    over = Window.orderBy("day")
    run = {t: F.sum(t).over(over) for t in TAGS}
    gained = functools.reduce(lambda a, b: a | b, [(F.col(t) > 0) & (run[t] - F.col(t) < 150) for t in TAGS])
    s = d.select("day", F.sum("n").over(over).alias("n"), F.least(*run.values()).alias("rarest"), gained.alias("gained"))
    last = F.coalesce(F.max(F.when(F.col("gained"), F.col("n"))).over(over), F.lit(0))
    s = s.select("day", "n", "rarest", last.alias("at"), (F.max("n").over(Window.partitionBy()) - F.col("n")).alias("rest"))
    return s.select("day", "n", E.stop_reason(F.col("n"), F.col("rarest"), F.col("n") - F.col("at"), F.col("rest"), per_tag=150, total=500, patience=300, cap=5000).alias("reason"))


#: The tags of an event: its user, its kind of value and whether it is a rare one.
WANTED = [*(f"u{k}" for k in range(7)), *(f"k{k}" for k in range(5)), "rare"]


@query(f"""WITH p AS (SELECT event_type AS dataset, event_id AS key, event_id % 17 <> 0 AS readable, list_distinct(['u' || (user_id % 7), 'k' || (json_extract_string(props, '$.k')::INT // 20), CASE WHEN value >= 80 THEN 'rare' ELSE 'common' END]) AS tags,
 row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) - 1 AS position FROM events),
 c AS (SELECT *, position // 50 AS chunk, count(*) FILTER (readable) OVER (PARTITION BY dataset ORDER BY position) AS n FROM p),
 u AS (SELECT *, row_number() OVER (PARTITION BY dataset, tag ORDER BY position) AS k FROM (SELECT dataset, chunk, position, n, unnest(tags) AS tag FROM c WHERE readable) WHERE tag IN ({", ".join(f"'{t}'" for t in WANTED)})),
 h AS (SELECT dataset, chunk, count(*) AS hits, max(n) AS best FROM u WHERE k = 20 GROUP BY 1, 2), e AS (SELECT dataset, chunk, max(n) AS n FROM c GROUP BY 1, 2),
 s AS (SELECT e.*, sum(coalesce(hits, 0)) OVER w AS met, coalesce(max(best) OVER w, 0) AS progress, max(chunk) OVER (PARTITION BY dataset) AS last FROM e LEFT JOIN h USING (dataset, chunk) WINDOW w AS (PARTITION BY dataset ORDER BY chunk)),
 r AS (SELECT *, CASE WHEN n >= 100 AND met = {len(WANTED)} THEN 'coverage' WHEN n >= 100 AND n - progress >= 150 THEN 'stalled' WHEN n >= 500 THEN 'cap' WHEN chunk = last THEN 'pool_exhausted' END AS reason FROM s),
 f AS (SELECT dataset, min(chunk) AS stop, arg_min(reason, chunk) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1)
 SELECT c.dataset, c.key, c.chunk::BIGINT AS chunk, reason FROM c JOIN f ON c.dataset = f.dataset AND c.chunk <= f.stop WHERE readable""")
def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images of five datasets, drawn by chunks until their tags are covered."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 20)
    tags = F.array(F.concat(F.lit("u"), F.col("user_id") % 7), F.concat(F.lit("k"), k), F.when(F.col("value") >= 80, "rare").otherwise("common"))
    d = table(spark, sf_dir, "events").select("event_id", "event_type", tags.alias("tags"))
    found = sampling.coverage_sample(d, "event_type", "event_id", "tags", F.col("event_id") % 17 != 0, WANTED, seed=7, per_tag=20, total=100, patience=150, cap=500)
    return found.where("readable").drop("readable")


@query("SELECT o_orderkey, o_orderstatus AS status, ((row_number() OVER (ORDER BY o_orderstatus, md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return folds.balanced(d, 5, ["o_orderkey"], "status")


@query("""WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS i FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)),
 p(i, load, held) AS (SELECT 0::BIGINT, [0::BIGINT, 0, 0, 0, 0], [0::BIGINT, 0, 0, 0, 0] UNION ALL
 SELECT g.i, list_transform(load, lambda x, j: x + CASE WHEN j = list_position(load, list_min(load)) THEN n ELSE 0 END), list_transform(held, lambda x, j: x + CASE WHEN j = list_position(load, list_min(load)) THEN 1 ELSE 0 END) FROM p JOIN g ON g.i = p.i + 1),
 e AS (SELECT load, held FROM p ORDER BY i DESC LIMIT 1) SELECT (k - 1)::INT AS fold, load[k]::BIGINT AS n, held[k]::BIGINT AS suppliers FROM e, range(1, 6) AS r(k)""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and suppliers of each fold when no supplier is cut."""
    d = folds.grouped(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey"), 5, "l_suppkey")
    by = d.groupBy("fold", "l_suppkey").agg(F.count("*").alias("n"))
    return by.groupBy("fold").agg(F.sum("n").alias("n"), F.count("*").alias("suppliers"))


@query("""WITH o AS (SELECT o_orderstatus AS status, o_custkey::DOUBLE AS y, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey))
 SELECT status, count(*) AS n, greatest(1, count(*) // 3)::BIGINT AS n_bottom, round(avg(y) FILTER (k <= greatest(1, n // 3)), 6) AS bottom_mean, round(avg(y) FILTER (k > n - greatest(1, n // 3)), 6) AS top_mean,
 round(avg(y) FILTER (k <= greatest(1, n // 3)) - avg(y) FILTER (k > n - greatest(1, n // 3)), 6) AS effect, true AS inside FROM o GROUP BY 1""")
def tertile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects by status; whether each is inside its interval."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice", "o_custkey", "o_orderkey")
    found = readiness.tertile_effects(d, ["status"], "o_totalprice", "o_custkey", ["o_orderkey"])
    inside = (F.col("ci_low") < F.col("effect")) & (F.col("effect") < F.col("ci_high"))
    return found.select("status", "n", "n_bottom", *[r(F.col(c)).alias(c) for c in ("bottom_mean", "top_mean", "effect")], inside.alias("inside"))


#: Fits of a model with one 0/1 predictor, whose solutions are those of the two groups' means.
SATURATED = {"ols": "l_extendedprice / 1000", "poisson": "l_linenumber::DOUBLE", "binomial": "(l_discount >= 0.05)::INT::DOUBLE", "fractional": "l_discount"}
_LINK = {"ols": "{}", "poisson": "ln({})", "binomial": "ln({0} / (1 - {0}))", "fractional": "ln({0} / (1 - {0}))"}
_MEANS = " UNION ALL ".join(f"SELECT '{f}' AS model, {_LINK[f].format('avg(y) FILTER (x = 0)')} AS b0, {_LINK[f].format('avg(y) FILTER (x = 1)')} AS b1 FROM (SELECT {y} AS y, x FROM d)" for f, y in SATURATED.items())


@query(f"""WITH d AS (SELECT *, (l_returnflag = 'R')::INT AS x, l_suppkey AS c FROM lineitem), m AS ({_MEANS}),
 e AS (SELECT x, c, {SATURATED["ols"]} - avg({SATURATED["ols"]}) OVER (PARTITION BY x) AS e, count(*) OVER (PARTITION BY x) AS n FROM d),
 h AS (SELECT sum(e * e / ((1 - 1 / n) * (1 - 1 / n)) / (n * n)) FILTER (x = 0) AS v0, sum(e * e / ((1 - 1 / n) * (1 - 1 / n)) / (n * n)) FILTER (x = 1) AS v1, count(*) AS rows FROM e),
 u AS (SELECT c, coalesce(sum(e / n) FILTER (x = 0), 0) AS u0, coalesce(sum(e / n) FILTER (x = 1), 0) AS u1 FROM e GROUP BY 1),
 g AS (SELECT sum(u0 * u0) AS v0, sum((u1 - u0) * (u1 - u0)) AS v1, count(*) / (count(*) - 1) * (any_value(rows) - 1) / (any_value(rows) - 2) AS f FROM u, h)
 SELECT model, round(b0, 6) AS const, round(b1 - b0, 6) AS slope, CASE WHEN model = 'ols' THEN round(sqrt(h.v0), 6) END AS se_const, CASE WHEN model = 'ols' THEN round(sqrt(h.v0 + h.v1), 6) END AS se_slope,
 CASE WHEN model = 'ols' THEN round(sqrt(g.v0 * f), 6) END AS clustered_const, CASE WHEN model = 'ols' THEN round(sqrt(g.v1 * f), 6) END AS clustered_slope FROM m, h, g""")
def saturated_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four families by their solvers, and the robust and clustered errors of least squares."""
    d = table(spark, sf_dir, "lineitem").withColumn("x", (F.col("l_returnflag") == "R").cast("double")).withColumn("c", F.col("l_suppkey"))
    rows = []
    for family, y in SATURATED.items():
        own = d.select("x", "c", F.expr(y).alias("y"))
        fit = models.ols(own, "y", ["x"]) if family == "ols" else models.glm(own, "y", ["x"], family)
        errors = [None] * 4
        if family == "ols":
            errors = [float(v) for group in (None, "c") for v in np.sqrt(np.diag(models.robust(own, fit, "y", group).covariance))]
        rows.append((family, *map(float, fit.coef), *errors))
    found = spark.createDataFrame(rows, "model string, const double, slope double, se_const double, se_slope double, clustered_const double, clustered_slope double")
    return found.select("model", *[r(F.col(c)).alias(c) for c in found.columns[1:]])
