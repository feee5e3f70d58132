"""Operators of metric evaluation, each as a query on the driver's tables with its SQL.

A metric record is a row of ``lineitem``: ``f1`` is the discount where the line number
is even (null elsewhere), ``iou`` the tax, ``near`` the quantity over 50, ``fn`` and
``gt`` are discount times quantity and quantity, strata are return flag and status.
Taggers A and B are the event types of a user at even and odd event ids. Values are
rounded on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import taxonomy as T
from ..operators import evaluation as V
from ..operators import lanes
from ..operators import order as O
from ..operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("f1"), F.col("l_tax").alias("iou"), (F.col("l_quantity") / 50).alias("near"),
        (F.col("l_discount") * F.col("l_quantity")).alias("fn"), F.col("l_quantity").alias("gt"), F.col("l_extendedprice").alias("price"),
    )


REC = """WITH rec AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_returnflag AS flag, l_linestatus AS status,
 CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS f1, l_tax AS iou, l_quantity / 50 AS near,
 l_discount * l_quantity AS fn, l_quantity AS gt, l_extendedprice AS price FROM lineitem) """


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


@query(REC + """SELECT flag, count(*) AS n, count(f1) AS n_f1, round(avg(f1), 6) AS mean_f1, round(sum(fn) / nullif(sum(gt), 0), 6) AS pooled_fn,
 round(avg((coalesce(f1 * 0.35, 0) + iou * 0.10 + near * 0.20) / (CASE WHEN f1 IS NULL THEN 0 ELSE 0.35 END + 0.30)), 6) AS mean_score,
 round(CASE WHEN count(CASE WHEN status = 'F' THEN f1 END) >= 3 AND count(CASE WHEN status = 'O' THEN f1 END) >= 3
 THEN avg(CASE WHEN status = 'F' THEN f1 END) - avg(CASE WHEN status = 'O' THEN f1 END) END, 6) AS gap FROM rec GROUP BY flag""")
def stratified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = records(spark, sf_dir)
    score = E.weighted_mean([(F.col("f1"), 0.35), (F.col("iou"), 0.10), (F.col("near"), 0.20)])
    return d.groupBy("flag").agg(
        F.count("*").alias("n"), F.count("f1").alias("n_f1"), r(E.mean(F.col("f1"))).alias("mean_f1"), r(E.pooled(F.col("fn"), F.col("gt"))).alias("pooled_fn"),
        r(F.avg(score)).alias("mean_score"), r(E.gap(F.col("f1"), F.col("status") == "F", F.col("status") == "O")).alias("gap"),
    )


@query(REC + """SELECT ok, ln, round(100 * (coalesce(f1 * 0.35, 0) + iou * 0.20 + near * 0.20) / (CASE WHEN f1 IS NULL THEN 0 ELSE 0.35 END + 0.40), 6) AS r2 FROM rec""")
def renormalised_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ok", "ln", r(100 * E.weighted_mean([(F.col("f1"), 0.35), (F.col("iou"), 0.20), (F.col("near"), 0.20)])).alias("r2"))


@query(REC + """SELECT flag, status, count(*) AS images, count(f1) AS eligible, round(avg(CASE WHEN f1 > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rate,
 round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS sd_f1, round(quantile_cont(f1, 0.5), 6) AS median_f1,
 round(sum(fn) FILTER (WHERE f1 IS NOT NULL) / nullif(sum(gt) FILTER (WHERE f1 IS NOT NULL), 0), 6) AS pooled, bool_or(f1 > 0.09) AS any_high FROM rec GROUP BY flag, status""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.detection(records(spark, sf_dir), ["flag", "status"], F.col("f1"), F.col("fn"), F.col("gt"), 0.05, 0.09)
    return d.select("flag", "status", "images", "eligible", *[r(F.col(c)).alias(n) for c, n in (("rate", "rate"), ("mean", "mean_f1"), ("spread", "sd_f1"), ("median", "median_f1"), ("pooled", "pooled"))], "any_high")


@query("""WITH g AS (SELECT c_mktsegment AS model, n_name AS dataset, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
 SELECT model, count(*) AS datasets, round(avg(m), 4) AS mean_metric,
 round(CASE WHEN count(m) >= 2 AND avg(m) <> 0 THEN greatest(0, least(1, 1 - stddev_pop(m) / avg(m))) END, 6) AS consistency FROM g GROUP BY model""")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("dataset"))
    g = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("model"), "dataset").agg(F.avg("c_acctbal").alias("m"))
    return g.groupBy("model").agg(F.count("*").alias("datasets"), r(F.avg("m"), 4).alias("mean_metric"), r(E.consistency(F.col("m"))).alias("consistency"))


@query(REC + """, m AS (SELECT flag, count(*) AS n, avg(f1) AS a, avg(near) AS b FROM rec WHERE flag IS NOT NULL GROUP BY flag HAVING count(*) >= 3),
 b AS (SELECT * FROM m ORDER BY CASE flag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, n DESC, flag LIMIT 1)
 SELECT m.flag AS flag, m.n AS n, b.flag AS baseline, round(m.a, 6) AS mean_f1, round(m.b, 6) AS mean_near,
 round(coalesce(b.a - m.a, 0) + coalesce(b.b - m.b, 0), 6) AS "drop" FROM m, b WHERE (SELECT count(*) FROM m) >= 2""")
def condition_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.degradation(records(spark, sf_dir), "flag", ["f1", "near"], 3, ["N", "R"])
    return d.select("flag", "n", "baseline", r(F.col("mean_f1")).alias("mean_f1"), r(F.col("mean_near")).alias("mean_near"), r(F.col("drop")).alias("drop"))


LISTS = """WITH a AS (SELECT l_orderkey AS k, list(l_discount) AS fw, list(l_tax) FILTER (WHERE l_linenumber > 1) AS bw FROM lineitem GROUP BY 1) """


@query(LISTS + """, g AS (SELECT k, d AS delta, CASE WHEN len(coalesce(bw, [])) > 0 THEN len(list_filter(bw, lambda x: x <= d)) / len(bw) END AS p,
 len(list_filter(fw, lambda x: x <= d)) / len(fw) AS rc FROM a, unnest([0.02, 0.05, 0.08]::DOUBLE[]) AS t(d)),
 s AS (SELECT *, CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END AS f FROM g)
 SELECT delta, round(avg(p), 6) AS mean_precision, round(avg(rc), 6) AS mean_recall, round(avg(f), 6) AS mean_f1, count(f) AS n_f1 FROM s GROUP BY delta""")
def support_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_discount").alias("fw"), F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_tax"))).alias("bw"))
    c = R.support_curve(d, ["k"], "fw", "bw", [0.02, 0.05, 0.08])
    return c.select("delta", *[r(F.col(x)).alias(x) for x in ("mean_precision", "mean_recall", "mean_f1")], "n_f1")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE isfinite(value) GROUP BY event_type")
def pooled_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.percentiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.95])
    return d.select("event_type", r(F.col("q0")).alias("p95"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
 count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
 SELECT tp, fp, fn, tn, round((tp / (tp + fp + fn + 1e-12) + tn / (tn + fp + fn + 1e-12)) / 2, 6) AS miou, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall, round(tp / (tp + fp + fn + 1e-12), 6) AS iou,
 round(2 * tp / (2 * tp + fp + fn + 1e-12), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn + 1e-12), 6) AS accuracy FROM c""")
def confusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return c.select("tp", "fp", "fn", "tn", *[r(F.col(x)).alias(x) for x in ("precision", "recall", "iou", "miou", "f1", "accuracy")])


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda odd: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == odd, F.col("event_type"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(own(0).alias("a"), own(1).alias("b"))


TAGS = """WITH t AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS a,
 coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id),
 c AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM t) """


@query(TAGS + "SELECT user_id, CASE WHEN u = 0 THEN 1.0 ELSE round(i / u, 6) END AS jaccard, i = u AS exact FROM c")
def tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return tagged(spark, sf_dir).select("user_id", r(E.jaccard(a, b)).alias("jaccard"), (F.size(F.array_intersect(a, b)) == F.size(F.array_union(a, b))).alias("exact"))


@query(TAGS + """, s AS (SELECT sum(i) AS tp, sum(len(a) - i) AS fp, sum(len(b) - i) AS fn FROM c)
 SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""")
def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.size(F.array_intersect("a", "b"))
    s = tagged(spark, sf_dir).agg(F.sum(i).alias("tp"), F.sum(F.size("a") - i).alias("fp"), F.sum(F.size("b") - i).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", r(E.ratio(tp, tp + fp)).alias("precision"), r(E.ratio(tp, tp + fn)).alias("recall"), r(E.f1(tp, fp, fn)).alias("f1"))


@query(TAGS + "SELECT x.tag AS tag, count(*) AS n FROM t, unnest(a) AS x(tag) GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select(F.explode("a").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(TAGS + "SELECT user_id, (u - i)::INT AS differ FROM c ORDER BY differ DESC, user_id LIMIT 20")
def most_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    differ = F.size(F.array_union("a", "b")) - F.size(F.array_intersect("a", "b"))
    return tagged(spark, sf_dir).select("user_id", differ.alias("differ")).orderBy(F.desc("differ"), "user_id").limit(20)


@query(TAGS + """SELECT user_id, list_contains(a, 'click')::INT AS tag_click, list_contains(a, 'view')::INT AS tag_view, list_contains(a, 'purchase')::INT AS tag_purchase FROM t""")
def one_hot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_hot(tagged(spark, sf_dir), ["user_id"], "a", ["click", "view", "purchase"], "tag_")


@query("""WITH d AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
 k AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM d)
 SELECT flag, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM k GROUP BY flag""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return d.select(F.col("l_returnflag").alias("flag"), "n", r(F.col("rho")).alias("rho"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r
 FROM lineitem GROUP BY 1""")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), r(E.pearson(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))


@query("""WITH o AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
 SELECT count(*) AS n, round(avg(y) FILTER (WHERE k <= greatest(1, n // 3)) - avg(y) FILTER (WHERE k > n - greatest(1, n // 3)), 6) AS effect FROM o""")
def tertile_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tertile_effect(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"]).select("n", r(F.col("effect")).alias("effect"))


@query("""WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS median FROM orders)
 SELECT round(median, 6) AS median, round(avg(o_custkey) FILTER (WHERE o_totalprice <= median), 6) AS low_mean, round(avg(o_custkey) FILTER (WHERE o_totalprice > median), 6) AS high_mean
 FROM orders, m GROUP BY median""")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.median_split(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")
    return d.select(*[r(F.col(c)).alias(c) for c in ("median", "low_mean", "high_mean")])


@query("""WITH s AS (SELECT user_id, ts, event_id, value > 50 AS state FROM events),
 c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
 SELECT user_id, run::BIGINT AS run, any_value(state) AS state, count(*) AS length FROM n GROUP BY user_id, run""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    return R.runs(d, ["user_id"], ["ts", "event_id"], "high").select("user_id", "run", "state", "length")


@query("""WITH d AS (SELECT l_returnflag AS flag, l_orderkey AS ok, l_linenumber AS ln, l_extendedprice AS price FROM lineitem),
 w AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY price DESC, ok, ln) AS t, row_number() OVER (PARTITION BY flag ORDER BY price, ok DESC, ln DESC) AS b FROM d)
 SELECT flag, ok, ln, price, t::INT AS place, 'top' AS side FROM w WHERE t <= 50 UNION ALL SELECT flag, ok, ln, price, b::INT, 'bottom' FROM w WHERE b <= 50""")
def top_and_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_and_bottom(records(spark, sf_dir).select("flag", "ok", "ln", "price"), ["flag"], "price", 50, ["ok", "ln"])


@query("""SELECT event_id FROM events WHERE ('0x' || substr(sha256('7:' || event_id::VARCHAR), 1, 8))::BIGINT / 4294967295 < 0.07""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(E.hash_share("7", F.col("event_id")) < 0.07).select("event_id")


@query("""WITH o AS (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey AS k, sha256('13:' || o_orderkey::VARCHAR) AS h FROM orders),
 w AS (SELECT *, row_number() OVER (PARTITION BY p, s ORDER BY h, k) AS place, count(*) OVER (PARTITION BY p, s) AS n FROM o)
 SELECT p, s, k FROM w WHERE place <= least(n, greatest(3, round_even(n * 0.05, 0)))""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k"))
    return R.stratified_sample(d, ["p", "s"], "k", 0.05, 3, "13")


@query("SELECT c_mktsegment AS segment, sha256(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS fingerprint FROM customer GROUP BY 1")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fingerprints(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment", "c_name")


@query("SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def left_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query("SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS num_evaluated, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS num_without_match FROM documents")
def counted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counted_match(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH b AS (SELECT c_custkey AS id, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS k0,
 (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) AS k1 FROM customer)
 SELECT id, CASE WHEN k0 IS NOT NULL THEN 0 WHEN k1 IS NOT NULL THEN 1 END AS key_rank, coalesce(k0, k1) AS record FROM b""")
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("s0"), F.col("c_nationkey").cast("long").alias("s1"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("r0"), F.lit(None).cast("long").alias("r1"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record"), F.lit(None).cast("long").alias("r0"), F.col("s_nationkey").cast("long").alias("r1"))
    return R.fallback_join(samples, a.unionByName(b), "id", "record", [("s0", "r0"), ("s1", "r1")]).select("id", "key_rank", "record")


@query("""WITH w AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events)
 SELECT f.user_id AS user_id, f.event_id AS first_id, l.event_id AS last_id FROM w f JOIN w l ON f.user_id = l.user_id AND f.f = 1 AND l.l = 1""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", key).alias("first_id"), F.max_by("event_id", key).alias("last_id"))


@query("""WITH x AS (SELECT p_partkey, list_transform(string_split(lower(coalesce(p_type, '')), ' '), lambda z: trim(z)) AS t FROM part)
 SELECT p_partkey, CASE WHEN list_contains(t, 'promo') THEN 'occluded' WHEN list_contains(t, 'small') THEN 'degraded' WHEN list_contains(t, 'large') THEN 'clear' ELSE 'not_applicable' END AS grp FROM x""")
def visibility_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"promo": "Occluded", "small": "Low Contrast", "large": " Clearly Visible"}
    words = F.transform(F.split(F.lower("p_type"), " "), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), w), w))
    return table(spark, sf_dir, "part").select("p_partkey", E.visibility_group(F.array_join(words, ";")).alias("grp"))


@query(REC + """SELECT ok, ln, u.metric AS metric, u.flagged AS flagged FROM rec, unnest([{metric: 'f1', flagged: coalesce(f1 < 0.03, false)}, {metric: 'iou', flagged: coalesce(iou >= 0.06, false)}, {metric: 'near', flagged: coalesce(near > 0.5, false)}]) AS t(u)""")
def threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivot_flags(records(spark, sf_dir), ["ok", "ln"], {"f1": ("lt", 0.03), "iou": ("gte", 0.06), "near": ("gt", 0.5)})


@query("""SELECT o_orderkey, CASE WHEN r1 >= 80 AND r2 >= 80 THEN 'HIGH' WHEN r1 >= 60 OR r2 >= 60 THEN 'MODERATE' ELSE 'LOW' END AS cls
 FROM (SELECT o_orderkey, o_totalprice / 5000 AS r1, o_custkey % 100 AS r2 FROM orders)""")
def readiness_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", E.readiness_class(F.col("o_totalprice") / 5000, F.col("o_custkey") % 100).alias("cls"))


@query("""WITH g AS (SELECT l_returnflag AS flag, l_discount AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
 c AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY v) AS run, sum(w) OVER (PARTITION BY flag) AS total FROM g)
 SELECT flag, min(v) AS quantile FROM c WHERE run >= total * 0.75 GROUP BY flag""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_linenumber", 0.75).withColumnRenamed("l_returnflag", "flag")


@query("""WITH v AS (SELECT vec_id, vec_id // 8 AS image, embedding AS e FROM embeddings)
 SELECT g.vec_id AS gt_id, max(len(list_filter(list_zip(g.e, p.e), lambda z: abs(z[1] - z[2]) < 0.05)) / 64) AS best
 FROM v g JOIN v p ON g.image = p.image AND g.vec_id % 2 = 1 AND p.vec_id % 2 = 0 GROUP BY 1""")
def best_lane_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lane of the reference against the predicted ones of its image."""
    v = table(spark, sf_dir, "embeddings").withColumn("image", F.floor(F.col("vec_id") / 8))
    d = V.best_match(v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "gt_id"), v.where("vec_id % 2 = 0"), "image", "gt_id", "embedding", 0.05)
    return d.where("best is not null")


@query("""WITH o AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
 SELECT user_id, count(nxt) AS pairs, round(avg(nxt - value), 6) AS mean_step FROM o GROUP BY user_id""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = table(spark, sf_dir, "events").withColumn("nxt", following)
    return d.groupBy("user_id").agg(F.count("nxt").alias("pairs"), r(F.avg(F.col("nxt") - F.col("value"))).alias("mean_step"))


@query("""SELECT o_orderpriority AS p, count(*) AS n, 'numeric' AS kind, 0.0::DOUBLE AS missing, count(DISTINCT o_orderstatus) AS levels, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
 round(quantile_cont(o_totalprice, 0.5), 6) AS q2, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS most, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1""")
def predictor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.profile(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "p"), ["p"], "o_totalprice", "o_orderstatus")
    return d.select("p", "n", "kind", r(F.col("missing")).alias("missing"), "levels", "least", *[r(F.col(f"q{k}")).alias(f"q{k + 1}") for k in range(3)], "most", r(F.col("spread"), 4).alias("sd"))


@query("""SELECT event_id, CASE WHEN k IS NULL THEN NULL WHEN k >= 50 THEN 1.0 ELSE 0.0 END AS outcome, CASE WHEN k <> 0 THEN round(value / k, 6) END AS ratio_var, ((coalesce(k, 0) >= 50) AND value > 50)::INT AS both_high
 FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def derived_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    k, v = F.col("k"), F.col("value")
    outcome = F.when(k.isNotNull(), (k >= 50).cast("double"))
    return d.select("event_id", outcome.alias("outcome"), r(E.ratio(v, k)).alias("ratio_var"), ((F.coalesce(k, F.lit(0)) >= 50) & (v > 50)).cast("int").alias("both_high"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 ELSE ((p_size - 1) // 10)::INT END AS n_rows, CASE WHEN p_size <= 10 THEN NULL ELSE (((p_size - 1) // 10) * 10)::INT END AS last_row FROM part""")
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.grid(F.col("p_size"), 10)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(g).alias("n_rows"), F.try_element_at(g, F.lit(-1)).alias("last_row"))


@query(REC + """SELECT flag, status, count(*) AS n, round(avg(near), 6) AS mean_near FROM rec GROUP BY ROLLUP(flag, status)""")
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).rollup("flag", "status").agg(F.count("*").alias("n"), r(F.avg("near")).alias("mean_near"))


_LANES = "SELECT l_orderkey AS image, CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END AS s, l_tax * 10 AS c, l_quantity AS u FROM lineitem"


@query(f"""WITH a AS ({_LANES}), m AS (SELECT image, 2 * median(greatest(u, 1e-9)) AS cap FROM a WHERE s IS NOT NULL GROUP BY 1),
 w AS (SELECT a.*, greatest(c, 0.15) * sqrt(least(greatest(u, 1e-9), greatest(cap, 1e-9))) AS w FROM a JOIN m USING (image) WHERE s IS NOT NULL),
 f AS (SELECT image, sum(w * s) / sum(w) AS ac, sum(w * c) / sum(w) AS cc, median(s) AS med, max(s) AS top, count(*) AS n FROM w GROUP BY 1), i AS (SELECT image, count(*) FILTER (s IS NULL) AS unknown FROM a GROUP BY 1)
 SELECT image, round(ac, 6) AS alignment_complexity, round(coalesce(cc, 0), 6) AS complexity_confidence, round(med, 6) AS median, top AS max, coalesce(n, 0) AS valid_count, unknown AS unknown_count,
 CASE WHEN n IS NULL THEN 'no_valid_lane_geometry_complexity' END AS unavailable_reason FROM i LEFT JOIN f USING (image)""")
def image_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as lanes of an image; those of number 3 have no score."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("c"), F.col("l_quantity").alias("u"))
    found = lanes.complexity(d, ["image"], "s", "c", "u")
    return found.withColumns({c: r(F.col(c)) for c in ("alignment_complexity", "complexity_confidence", "median")})


@query("""WITH a AS (SELECT l_returnflag AS flag, l_extendedprice AS v, l_quantity AS w FROM lineitem WHERE l_linenumber > 1), c AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY v, w ROWS UNBOUNDED PRECEDING) - w / 2 AS mid, sum(w) OVER (PARTITION BY flag) AS total FROM a),
 n AS (SELECT *, lead(v) OVER o AS nv, lead(mid) OVER o AS nm, row_number() OVER o AS k FROM c WINDOW o AS (PARTITION BY flag ORDER BY mid)), q AS (SELECT unnest([0.0, 0.25, 0.95]) AS q),
 f AS (SELECT flag, q, max(CASE WHEN k = 1 AND q * total <= mid THEN v WHEN nv IS NULL AND q * total >= mid THEN v WHEN mid <= q * total AND nm > q * total THEN v + (q * total - mid) / (nm - mid) * (nv - v) END) AS x FROM n, q GROUP BY 1, 2)
 SELECT flag, q::DOUBLE AS q, round(x, 4) AS quantile FROM f""")
def midpoint_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    return functools.reduce(DataFrame.unionByName, [lanes.midpoint_quantile(d, ["flag"], "l_extendedprice", "l_quantity", q).select("flag", F.lit(q).alias("q"), r(F.col("quantile"), 4).alias("quantile")) for q in (0.0, 0.25, 0.95)])


_WORDS = "[" + ", ".join(f"'{t}'" for t in T.every()) + "]"


@query(f"""WITH e AS (SELECT event_id, {_WORDS} AS words, CASE WHEN event_id % 11 = 0 THEN NULL ELSE [{_WORDS}[(user_id % 43 + 1)::INT], {_WORDS}[(event_id % 43 + 1)::INT], CASE WHEN event_id % 5 = 0 THEN 'Moonlight' ELSE 'Rain' END] END AS l FROM events)
 SELECT event_id, array_to_string(list_filter(range(1, 11), lambda k: list_contains(coalesce(l, []), words[33 + k])), ',') AS weather, coalesce(list_min(list_filter(range(1, 7), lambda k: list_contains(coalesce(l, []), words[27 + k]))), 0)::INT AS visibility,
 len(list_filter(words, lambda t: list_contains(coalesce(l, []), t)))::INT AS ones, array_to_string(list_filter(words, lambda t: list_contains(coalesce(l, []), t)), '; ') AS back, CASE WHEN list_contains(coalesce(l, []), 'Moonlight') THEN 'Moonlight' ELSE '' END AS unknown FROM e""")
def tag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags of an event and one that is sometimes none, as codes and back."""
    words = F.array(*map(F.lit, T.every()))
    label = F.array(F.get(words, (F.col("user_id") % 43).cast("int")), F.get(words, (F.col("event_id") % 43).cast("int")), F.when(F.col("event_id") % 5 == 0, "Moonlight").otherwise("Rain"))
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, label).alias("l"))
    d = d.withColumn("e", T.encoded(F.col("l")))
    return d.select(
        "event_id", F.array_join(F.col("e.codes.lighting_weather").cast("array<string>"), ",").alias("weather"), F.col("e.primary.visibility").alias("visibility"),
        F.aggregate("e.multi_hot", F.lit(0), lambda a, x: a + x).alias("ones"), F.array_join(T.decoded(F.col("e.multi_hot")), "; ").alias("back"), F.array_join(T.unknown(F.col("l")), "; ").alias("unknown"),
    )
