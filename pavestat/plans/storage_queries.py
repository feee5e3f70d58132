"""Readers, writers, kernels and ingestion: each query writes what it makes of the driver's
tables in the format of a source or sink, reads it back and sums it up, with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..operators import frames
from ..sources import file_sink, readers, resolvers, sheets, writers
from ..sources.scratch import scratch
from ..streaming.ingest import ingest
from .metric_queries import Query, r, table

STORAGE_QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        STORAGE_QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _text(df: DataFrame, name: str, value: Column) -> str:
    path = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


def _lane_sums(df: DataFrame, key: Column) -> DataFrame:
    """Lanes, points and the sum of x of each sample."""
    points = F.flatten("lanes")
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"])
    return df.select(key.alias("vec_id"), F.size("lanes").cast("long").alias("n_lanes"), F.size(points).cast("long").alias("n_points"), r(total, 5).alias("sum_x"))


V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), "
_KEPT = "CASE WHEN len(a) >= 2 THEN a ELSE [] END AS a, CASE WHEN len(b) >= 2 THEN b ELSE [] END AS b"
_SUMS = "SELECT vec_id, ((len(a) > 0)::INT + (len(b) > 0)::INT)::BIGINT AS n_lanes, (len(a) + len(b))::BIGINT AS n_points, round(coalesce(list_sum(a), 0) + coalesce(list_sum(b), 0), 5) AS sum_x FROM k"


@query(f"WITH {V} s AS (SELECT vec_id, list_filter(x[1:32], lambda z: z >= 0) AS a, list_filter(x[33:64], lambda z: z >= 0) AS b FROM v), k AS (SELECT vec_id, {_KEPT} FROM s) {_SUMS}")
def tusimple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lanes a frame as JSON lines; x under 0 is no point."""
    v = _vectors(spark, sf_dir)
    body = F.struct(F.concat(F.lit("clips/"), F.col("vec_id").cast("string")).alias("raw_file"), F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("lanes"), F.sequence(F.lit(10), F.lit(320), F.lit(10)).alias("h_samples"))
    got = readers.tusimple(spark, _text(v, "tusimple", F.to_json(body)))
    return _lane_sums(got, F.substring_index("sample_id", "_", -1).cast("long"))


@query(f"WITH {V} s AS (SELECT vec_id, x[1:2] AS a, x[33:40] AS b FROM v), k AS (SELECT vec_id, {_KEPT} FROM s) {_SUMS}")
def curvelanes_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose numbers are text; a point that is none is dropped."""
    v = _vectors(spark, sf_dir)
    lane = lambda a, n: F.concat(F.transform(F.slice("x", a, n), lambda x: F.struct(x.cast("string").alias("x"), F.lit("1.5").alias("y"))), F.array(F.struct(F.lit("none").alias("x"), F.lit("1").alias("y"))))
    body = F.to_json(F.struct(F.array(lane(1, 2), lane(33, 8)).alias("Lines"), "vec_id"))
    told = spark.read.text(_text(v, "curvelanes", body))
    return _lane_sums(readers.curvelane_text(told, "value"), F.get_json_object("value", "$.vec_id").cast("long"))


_BITS = "list_transform(generate_series(1, 64), lambda i: (x[i] > {})::INT)"


@query(f"""WITH {V} b AS (SELECT vec_id, {_BITS.format("0.05")} AS p, {_BITS.format("0")} AS g FROM v),
 c AS (SELECT vec_id, len(list_filter(list_zip(p, g), lambda z: z[1] = 1 AND z[2] = 1)) AS tp, len(list_filter(list_zip(p, g), lambda z: z[1] = 1 AND z[2] = 0)) AS fp, len(list_filter(list_zip(p, g), lambda z: z[1] = 0 AND z[2] = 1)) AS fn,
 len(list_filter(list_zip(p[49:64], g[49:64]), lambda z: z[1] = 1 AND z[2] = 1)) AS ntp, len(list_filter(list_zip(p[49:64], g[49:64]), lambda z: z[1] = 1 OR z[2] = 1)) AS nall, list_sum(g[49:64]) AS ng FROM b)
 SELECT vec_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + fp > 0)::INT AS detected, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fp + fn), 6) END AS iou, CASE WHEN tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1,
 CASE WHEN ng > 0 THEN round(ntp / nall, 6) END AS near_iou, CASE WHEN tp + fn > 0 THEN round(fn / (tp + fn), 6) END AS missed FROM c""")
def mask_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 8 by 8 pixels as PNG, written, read back, decoded and compared."""
    bits = lambda bound: F.transform("x", lambda x: (x > bound).cast("int"))
    masks = masks_of(_vectors(spark, sf_dir).select("vec_id", bits(0.05).alias("p"), bits(0.0).alias("g")), {"pred": "p", "gt": "g"}, 8)
    path = scratch(spark, "masks")
    masks.select("vec_id", "pred", "gt").write.parquet(path)
    d = frames.detection_records(spark.read.parquet(path), widened=False)
    return d.select("vec_id", F.col("D3_tp").alias("tp"), F.col("D3_fp").alias("fp"), F.col("D3_fn").alias("fn"), F.col("D1_detection").alias("detected"), r(F.col("D3_iou")).alias("iou"), r(F.col("D3_f1")).alias("f1"), r(F.col("D4_near_iou")).alias("near_iou"), r(F.col("D6_image_missed_ratio")).alias("missed"))


def masks_of(df: DataFrame, columns: dict[str, str], width: int) -> DataFrame:
    """PNG masks from arrays of 0 and 1, row after row."""

    def kernel(row: dict) -> dict:
        return {n: raster.write_png(np.array(row[c], np.uint8).reshape(-1, width) * np.uint8(255)) for n, c in columns.items()}

    return frames._mapped(df, ", ".join(f"{n} binary" for n in columns), kernel).drop("reason")


@query(f"""WITH {V} e AS (SELECT vec_id, unnest(x[1:16]) AS x FROM v)
 SELECT vec_id, count(*) AS n_rows, sum(round_even(200 + 100 * x, 0))::BIGINT AS total FROM e GROUP BY 1""")
def lane_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with a point at each row of the grid: drawn, and their x there read off."""
    lane = F.transform(F.slice("x", 1, 16), lambda x, i: F.array(200 + 100 * x, (10.0 * (i + 1)).cast("double")))
    d = frames.draw_lanes(_vectors(spark, sf_dir).select("vec_id", F.array(lane).alias("lanes"), F.lit(170).alias("height"), F.lit(400).alias("width")))
    xs = F.flatten("grid_xs")
    return d.select("vec_id", F.size(xs).cast("long").alias("n_rows"), F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH {V} e AS (SELECT vec_id, unnest(x[1:32]) AS a, unnest(x[33:64]) AS b FROM v) SELECT vec_id, round(avg((abs(a - b) * 100 < 20 AND a >= 0 AND b >= 0)::INT + (a < 0 AND b < 0)::INT), 6) AS accuracy FROM e GROUP BY 1""")
def flat_lane_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one lane against another's at the same rows, both without a point agreeing.
    The reference lane stands upright, so points match within 20 pixels."""
    v = _vectors(spark, sf_dir)
    upright = F.transform(F.slice("x", 33, 32), lambda b: F.when(b >= 0, F.lit(500.0)).otherwise(-2.0))
    own = F.transform(F.arrays_zip(F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b")), lambda z: F.when(z["a"] >= 0, F.when(z["b"] >= 0, 500 + 100 * (z["a"] - z["b"])).otherwise(F.lit(900.0))).otherwise(-2.0))
    d = v.select("vec_id", F.array(own).alias("pred_xs"), F.array(upright).alias("gt_xs"), F.sequence(F.lit(10), F.lit(320), F.lit(10)).alias("rows"))
    return frames.line_accuracy(d).select("vec_id", r(F.col("accuracy")).alias("accuracy"))


@query("SELECT doc_id, quality::VARCHAR AS quality, source AS \"metadata.source\", lang AS \"metadata.lang\" FROM documents LEFT JOIN labels USING (doc_id)")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON and flat CSV; the CSV read back, its values text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.select("doc_id", "quality", F.struct("source", "lang").alias("metadata"), F.array("lang").alias("listed"))
    json, csv = scratch(spark, "records"), scratch(spark, "records") + ".csv"
    writers.write_records(d, json, csv, ["doc_id"])
    return readers.records(spark, csv).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT p_partkey AS k, c_acctbal AS d1, c_name AS core FROM part LEFT JOIN customer ON p_partkey = c_custkey")
def output_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with metrics by kind, written as JSON lines and read back."""
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), "p_name")
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("D1_balance"), F.col("c_name").alias("name"))
    path = scratch(spark, "manifest")
    writers.write_manifest(writers.output_manifest(found, samples), path)
    got = spark.read.schema("sample_id long, metrics struct<D: struct<D1_balance: double>, core: struct<name: string>>").json(path)
    return got.select(F.col("sample_id").alias("k"), F.col("metrics.D.D1_balance").alias("d1"), F.col("metrics.core.name").alias("core"))


@query("SELECT side, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT 'top' AS side, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part UNION ALL SELECT 'bottom', p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey DESC) FROM part) WHERE k <= 5 GROUP BY 1")
def ranking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst rows of each group as partitioned files, read back."""
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), "p_partkey", F.col("p_retailprice").alias("price"))
    path = scratch(spark, "ranking")
    writers.write_ranked(d, path, ["price"], ["p_partkey"], ["model"], 5)
    return spark.read.parquet(f"{path}/price").groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("SELECT user_id + 1000 * (event_id % 3) AS user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines through the stream in three batches. The second brings those of the
    first again, the third those of both, with other users: what stands there stays."""
    d = table(spark, sf_dir, "events").select("event_id", "user_id")
    source, sink, progress = (scratch(spark, name) for name in ("lines", "sink", "progress"))
    for batch in range(3):
        d.where(F.col("event_id") % 3 <= batch).select("event_id", (F.col("user_id") + 1000 * batch).alias("user_id")).write.mode("append").json(source)
        ingest(spark, source, "event_id long, user_id long", sink, progress, key="event_id").awaitTermination()
    return spark.read.parquet(sink).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_tags, max(event_type) AS last_tag FROM (SELECT * FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def tag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by dimension as JSON lines, with broken lines between; read back."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("sample_id"), F.lit("d").alias("dataset"), F.struct(F.create_map(F.lit("Kind"), F.col("t")).alias("by_dimension")).alias("predicted_tags")))
    path = _text(own, "tags", F.when(F.col("user_id") % 2 == 0, body).otherwise("{broken"))
    t = F.col("predicted_tags.by_dimension")["Kind"]
    return readers.tag_run(spark, path).select(F.col("sample_id").cast("long").alias("user_id"), F.size(t).cast("long").alias("n_tags"), F.array_max(t).alias("last_tag"))


@query(f"""WITH {V} s AS (SELECT vec_id, x[1:3] AS a, x[4:4] AS b FROM v) SELECT vec_id, 1::BIGINT AS n_lanes, round(list_sum(a), 5) AS sum_x, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 0.5 END AS score, 'polyline' AS geometry_source FROM s""")
def prediction_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest of all predicted lanes in both spellings of a point, read by parts; a lane of
    one point goes with its score."""
    v = _vectors(spark, sf_dir)
    point = F.transform(F.slice("x", 1, 3), lambda x: F.array(x, F.lit(1.0)))
    short = F.transform(F.slice("x", 4, 1), lambda x: F.array(x, F.lit(1.0)))
    score = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))).otherwise(F.array(F.lit(0.5), F.lit(0.7)))
    samples = v.select(F.col("vec_id").cast("string").alias("sample_id"), F.struct(F.array(point, short).alias("polylines"), score.alias("scores")).alias("prediction"))
    path = scratch(spark, "predictions")
    writers.write_ground_truth(samples, path, "vectors")
    got = readers.predictions(spark, path)
    total = F.aggregate(F.flatten("lanes"), F.lit(0.0), lambda s, p: s + p["x"])
    return got.select(F.col("sample_id").cast("long").alias("vec_id"), F.size("lanes").cast("long").alias("n_lanes"), r(total, 5).alias("sum_x"), F.get("scores", F.lit(0)).alias("score"), "geometry_source")


@query("""SELECT vec_id, (row_number() OVER (ORDER BY vec_id::VARCHAR) - 1)::INT AS position, vec_id || '.png' AS file, sha256('mask of ' || vec_id) AS digest, label FROM embeddings WHERE vec_id % 4 > 0
 UNION ALL SELECT vec_id, (row_number() OVER (ORDER BY vec_id::VARCHAR) - 1)::INT + (SELECT count(*) FROM embeddings WHERE vec_id % 4 > 0), NULL, NULL, label FROM embeddings WHERE vec_id % 4 = 0""")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as files beside a manifest that points to them, read back through it; every
    fourth sample has none and stands at the end."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("sample_id"), "label", F.when(F.col("vec_id") % 4 > 0, F.encode(F.concat(F.lit("mask of "), F.col("vec_id")), "utf-8")).alias("mask"))
    paths = file_sink.write_masks(d, scratch(spark, "masks"))
    out = scratch(spark, "manifest")
    samples = d.drop("mask").join(paths, "sample_id", "left").select("sample_id", F.struct("mask_path").alias("ground_truth"), F.struct("label").alias("meta"), F.col("mask_path").isNull().alias("without"))
    writers.write_ground_truth(samples, out, "vectors", order=["without", "sample_id"])
    got = readers.manifest(spark, out)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths.select("mask_path").first()[0].rsplit("/", 2)[0]).select("path", "content")
    back = got.join(files, F.col("mask_path") == F.col("path"), "left")
    return back.select(F.col("sample_id").cast("long").alias("vec_id"), "position", F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"), F.get_json_object("meta", "$.label").cast("int").alias("label"))


@query("""WITH p AS (SELECT *, list_filter(['Solid Line', 'Rain', 'Snow'], lambda x: (x = 'Solid Line' AND p_size % 2 = 0) OR (x = 'Rain' AND p_size % 3 = 0) OR (x = 'Snow' AND p_size > 40)) AS l FROM part)
 SELECT p_partkey, array_to_string(l, '; ') AS labels, p_name || '.jpg' AS file, CASE WHEN p_size % 5 > 0 THEN p_brand END AS summary, (SELECT count(*) FROM part WHERE p_size % 3 = 0) AS rainy FROM p""")
def tag_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of a tag sheet: written as CSV with its two headings and a row of totals,
    read back as labels; ``rainy`` is what the totals say of a tag if the rows agree."""
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    dims = ["Scenario", "Context", "Surface", "Marking", "Visibility", "Weather"]
    head = ["#", "File Name", *dims, "Solid Line", "Rain", "Snow"]
    flags = [F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size") > 40]
    row = F.concat_ws(",", F.col("p_partkey"), F.concat("p_name", F.lit(".jpg")), *[F.lit("")] * 3, F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).otherwise(""), *[F.lit("")] * 2, *[F.when(f, "1").otherwise(F.when(F.col("p_partkey") % 2 == 0, "0").otherwise("")) for f in flags])
    sums = d.agg(*[F.count_if(f).alias(f"n{k}") for k, f in enumerate(flags)]).select(F.concat(F.lit(",TOTAL (count),,,,,,,"), F.concat_ws(",", "n0", "n1", "n2")).alias("value"))
    first = spark.createDataFrame([(0, ",,Group,,,,,,Tags,,"), (1, ",".join(head))], "at int, value string")
    lines = first.unionByName(d.select(F.lit(2).alias("at"), row.alias("value"))).unionByName(sums.select(F.lit(3).alias("at"), "value"))
    path = scratch(spark, "sheet")
    lines.repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    checked = sheets.totals(spark, path).where("tag = 'Rain' and stated = counted").select(F.col("stated").alias("rainy"))
    found = sheets.sheet(spark, path).crossJoin(F.broadcast(checked))  # one row
    return found.select(F.col("row_index").alias("p_partkey"), F.array_join("labels", "; ").alias("labels"), F.col("file_name").alias("file"), F.col("summary")["Marking"].alias("summary"), "rainy")


#: Files that a page stands for: images and masks of two splits, frames and masks of clips of 25 pages.
_FILES = """SELECT '/d/bdd100k/images/' || s || '/' || (page_id // 2) || '.jpg' AS path FROM pages, (VALUES ('train'), ('val')) v(s) WHERE s = 'val' OR page_id % 2 = 0
 UNION ALL SELECT '/d/bdd100k/ll_seg_annotations/val/' || (page_id // 2) || '.png' FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT '/d/culane/driver_' || (page_id // 25 % 3) || '/c' || (page_id // 25) || '.MP4/' || lpad((page_id % 25)::VARCHAR, 5, '0') || '.jpg' FROM pages
 UNION ALL SELECT '/d/culane/laneseg_label_w16_test/driver_' || (page_id // 25 % 3) || '/c' || (page_id // 25) || '.MP4/' || lpad((page_id % 25)::VARCHAR, 5, '0') || '.png' FROM pages WHERE page_id // 25 % 3 = 1 AND page_id % 4 < 3"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id")
    half, clip = F.expr("page_id div 2"), F.expr("page_id div 25")
    at = F.concat(F.lit("driver_"), clip % 3, F.lit("/c"), clip, F.lit(".MP4/"), F.lpad((F.col("page_id") % 25).cast("string"), 5, "0"))
    paths = F.array(
        F.concat(F.lit("/d/bdd100k/images/val/"), half, F.lit(".jpg")), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/d/bdd100k/images/train/"), half, F.lit(".jpg"))),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/d/bdd100k/ll_seg_annotations/val/"), half, F.lit(".png"))), F.concat(F.lit("/d/culane/"), at, F.lit(".jpg")),
        F.when((clip % 3 == 1) & (F.col("page_id") % 4 < 3), F.concat(F.lit("/d/culane/laneseg_label_w16_test/"), at, F.lit(".png"))),
    )
    return d.select(F.explode(F.array_compact(paths)).alias("path"))


@query(f"""WITH f AS (SELECT DISTINCT path FROM ({_FILES})), n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'bdd100k' WHEN 1 THEN 'culane' ELSE 'tusimple' END AS dataset, CASE WHEN page_id % 3 = 1 THEN 'C' || (page_id // 20) || '.mp4' ELSE page_id::VARCHAR || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '' END END AS name FROM pages),
 i AS (SELECT regexp_extract(path, 'images/(.*)/(.*)[.]jpg', 2) AS key, min(CASE WHEN path LIKE '%/val/%' THEN 1 ELSE 2 END || path) AS best, count(*) AS n FROM f WHERE path LIKE '/d/bdd100k/images%' GROUP BY 1),
 m AS (SELECT regexp_extract(path, 'val/(.*)[.]png', 1) AS key, path AS mask FROM f WHERE path LIKE '%ll_seg%'),
 c AS (SELECT regexp_extract(path, '/(c[0-9]+)[.]MP4', 1) AS seg, count(*) FILTER (path LIKE '%jpg') AS frames, min(path) FILTER (path LIKE '%jpg') AS first, min(regexp_replace(path, '/[^/]*$', '')) FILTER (path LIKE '%png') AS dir FROM f WHERE path LIKE '/d/culane%' GROUP BY 1)
 SELECT page_id, dataset, CASE dataset WHEN 'bdd100k' THEN substr(best, 2) WHEN 'culane' THEN first END AS image_path, CASE WHEN dataset = 'bdd100k' THEN mask WHEN dataset = 'culane' THEN dir END AS truth_path, CASE WHEN dataset = 'culane' THEN frames END AS num_frames,
 dataset = 'bdd100k' AND coalesce(i.n, 0) > 1 AS ambiguous, CASE dataset WHEN 'tusimple' THEN 'bare numeric id without a path: unresolved' WHEN 'culane' THEN CASE WHEN first IS NULL THEN 'segment not found under any driver' ELSE 'a segment, not a single frame' END
 ELSE CASE WHEN best IS NULL THEN 'image not found' WHEN mask IS NULL THEN 'truth missing' ELSE '' END END AS note
 FROM n LEFT JOIN i ON dataset = 'bdd100k' AND i.key = replace(name, '.jpg', '') LEFT JOIN m ON dataset = 'bdd100k' AND m.key = replace(name, '.jpg', '') LEFT JOIN c ON dataset = 'culane' AND c.seg = lower(replace(name, '.mp4', ''))""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three datasets found in one listing of files."""
    n = table(spark, sf_dir, "pages").select("page_id")
    kind = F.col("page_id") % 3
    name = F.when(kind == 1, F.concat(F.lit("C"), F.expr("page_id div 20"), F.lit(".mp4"))).otherwise(F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise("")))
    n = n.select("page_id", F.when(kind == 0, "bdd100k").when(kind == 1, "culane").otherwise("tusimple").alias("dataset"), name.alias("file_name"))
    return resolvers.resolve(n, _listing(spark, sf_dir)).select("page_id", "dataset", "image_path", "truth_path", "num_frames", "ambiguous", "note")


@query(f"""WITH f AS (SELECT DISTINCT path FROM ({_FILES})), b AS (SELECT path, regexp_extract(path, 'val/(.*)[.]', 1) AS k FROM f WHERE path LIKE '/d/bdd100k/%/val/%'),
 c AS (SELECT path, regexp_extract(path, '(driver.*)[.]', 1) AS k FROM f WHERE path LIKE '/d/culane/%'), g AS (SELECT path, k, row_number() OVER (PARTITION BY regexp_extract(k, '(.*)/', 1) ORDER BY k) - 1 AS nth FROM c WHERE path LIKE '%jpg')
 SELECT 'bdd100k_val_' || i.k AS sample_id, i.path AS image_path, t.path AS truth_path FROM b i JOIN b t ON i.k = t.k AND i.path LIKE '%jpg' AND t.path LIKE '%png'
 UNION ALL SELECT 'culane_' || replace(g.k, '/', '_'), g.path, t.path FROM g JOIN c t ON g.k = t.k AND t.path LIKE '%png' WHERE nth % 10 = 0""")
def sampling_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with truth in the splits that samples are drawn from."""
    return resolvers.pool(_listing(spark, sf_dir)).select("sample_id", "image_path", "truth_path")


@query("SELECT p_partkey, p_name AS name, p_brand || ', ' || p_type AS kind, CASE WHEN p_size > 9 THEN p_size END AS size FROM part")
def sniffed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written with a semicolon between, commas within; read back by the delimiter that the
    first line tells."""
    path = scratch(spark, "table")
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(", ", "p_brand", "p_type").alias("kind"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("size"))
    d.write.option("header", True).option("sep", ";").csv(path)
    return readers.sniffed_csv(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "name", "kind", F.col("size").cast("int").alias("size"))
