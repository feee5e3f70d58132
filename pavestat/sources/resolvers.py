"""Files of lane datasets by name: one listing, indexed once by rules that are data.

A rule says what a path is: its dataset and role, its place (split or driver) and its key
within the place. Images and their truth have the same place and key, so enumerating,
resolving names and drawing pools are joins of one index with itself or with names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the paths of each dataset look like; the groups are place and key.
RULES = [
    ("bdd100k", "image", r"bdd100k/images/(train|val|test)/([^/]+)\.jpg$"),
    ("bdd100k", "truth", r"bdd100k/ll_seg_annotations/(train|val)/([^/]+)\.png$"),
    ("curvelanes", "image", r"Curvelanes/(train|valid|test)/images/([^/]+)\.jpg$"),
    ("curvelanes", "truth", r"Curvelanes/(train|valid)/labels/([^/]+)\.lines\.json$"),
    ("culane", "image", r"culane/(driver_[^/]+)/([^/]+\.MP4/[^/]+)\.jpg$"),
    ("culane", "lines", r"culane/(driver_[^/]+)/([^/]+\.MP4/[^/]+)\.lines\.txt$"),
    ("culane", "truth", r"culane/laneseg_label_w16/(driver_[^/]+)/([^/]+\.MP4/[^/]+)\.png$"),
    ("culane", "test_truth", r"culane/laneseg_label_w16_test/(driver_[^/]+)/([^/]+\.MP4/[^/]+)\.png$"),
    ("tusimple", "image", r"TUSimple/(train_set|test_set)/clips/(.+)\.jpg$"),
    ("tusimple", "truth", r"TUSimple/(train_set)/seg_label/(.+/20)\.png$"),
]
#: Splits by place, in the order in which a name is looked for.
ORDER = {"bdd100k": ["val", "train", "test"], "curvelanes": ["valid", "train", "test"]}
#: Splits of the pools that samples are drawn from, and each how-manieth frame of a segment.
POOLS, STRIDE = {"bdd100k": "val", "curvelanes": "valid", "culane": "test"}, 10
#: The kind of truth by dataset, in manifests and in pools.
KINDS = {"bdd100k": "lane_mask_png", "curvelanes": "lines_json", "culane": "culane_segment", "tusimple": "tusimple_lane_json"}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of all files below a folder, empty ones left out. No content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def indexed(files: DataFrame) -> DataFrame:
    """``(dataset, role, place, key, path)`` of the paths that a rule knows; all rules in one pass."""
    cells = [F.when(F.col("path").rlike(p), F.struct(F.lit(d).alias("dataset"), F.lit(r).alias("role"), F.regexp_extract("path", p, 1).alias("place"), F.regexp_extract("path", p, 2).alias("key"))) for d, r, p in RULES]
    return files.select("path", F.inline(F.array_compact(F.array(*cells)))).select("dataset", "role", "place", "key", "path")


def enumerated(files: DataFrame) -> DataFrame:
    """Every image: ``dataset, split, sample_id, place, key, image_path, truth_path, truth_found``.
    A driver of CULane that has masks among the tests' is of the test, and only such a mask
    counts there; without one it is of the train split. Repeated paths count once."""
    own = indexed(files).distinct()
    tests = own.where("role = 'test_truth'").select("dataset", "place").distinct().withColumn("tested", F.lit(True))
    images = own.where("role = 'image'").join(tests, ["dataset", "place"], "left").withColumn("tested", F.coalesce("tested", F.lit(False)))
    truth = own.where("role in ('truth', 'test_truth')").groupBy("dataset", "place", "key", (F.col("role") == "test_truth").alias("tested")).agg(F.min("path").alias("truth_path"))
    split = F.when(F.col("dataset") == "culane", F.when(F.col("tested"), "test").otherwise("train")).otherwise(F.regexp_replace("place", "_set$", ""))
    named = F.replace(F.when(F.col("dataset") == "culane", F.concat_ws("_", "dataset", "place", "key")).otherwise(F.concat_ws("_", "dataset", "split", "key")), F.lit("/"), F.lit("_"))
    found = images.withColumn("split", split).withColumn("sample_id", named).join(truth, ["dataset", "place", "key", "tested"], "left")
    return found.select("dataset", "split", "sample_id", "place", "key", F.col("path").alias("image_path"), "truth_path", F.col("truth_path").isNotNull().alias("truth_found"))


def pool(files: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The images with truth that samples are drawn from: of each dataset one split, of CULane each
    ``stride``-th frame of a segment, from its first."""
    own = enumerated(files)
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in POOLS.items() for x in pair]), F.col("dataset"))
    own = own.where(F.col("split") == wanted)
    frames = Window.partitionBy("dataset", "place", F.substring_index("key", "/", 1)).orderBy("key")  # a segment is one clip
    at = F.when(F.col("dataset") == "culane", F.row_number().over(frames) - 1).otherwise(0)
    return own.withColumn("at", at).where((F.col("at") % stride == 0) & F.col("truth_found")).drop("at")


def _stem(name: Column, suffix: str) -> Column:
    return F.regexp_replace(F.trim(name), rf"(?i)\.{suffix}$", "")


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """``names(dataset, file_name)`` with ``image_path, split, truth_path, kind, image_found,
    truth_found, num_frames, num_lines, ambiguous, note``, a row for each row. BDD100K and
    CurveLanes: the image of that name in the first split that has one, and its truth.
    CULane: a name is a segment, its image the segment's first frame, of the last driver that
    has it; masks of the first kind count before the tests'. TuSimple names are bare numbers
    and stay unresolved. ``ambiguous``: another image of the name was passed over."""
    index = indexed(files).distinct()
    order = F.element_at(F.create_map(*[x for d, places in ORDER.items() for x in (F.lit(d), F.lit(places))]), F.col("dataset"))
    images = index.where("role = 'image'").where(F.col("dataset").isin(*ORDER)).withColumn("rank", F.array_position(order, F.col("place")))
    first = images.groupBy("dataset", "key").agg(F.min(F.struct("rank", "path", "place")).alias("f"), (F.count("*") > 1).alias("ambiguous"))
    first = first.select("dataset", "key", F.col("f.place").alias("place"), F.col("f.path").alias("image_path"), "ambiguous")
    truth = index.where("role = 'truth'").where(F.col("dataset").isin(*ORDER)).groupBy("dataset", "place", "key").agg(F.min("path").alias("truth_path"))
    single = first.join(truth, ["dataset", "place", "key"], "left")
    single = single.select("dataset", "key", "image_path", F.col("place").alias("split"), "truth_path", F.lit(None).cast("long").alias("num_frames"), F.lit(None).cast("long").alias("num_lines"), "ambiguous")

    clips = index.where("dataset = 'culane'").withColumn("segment", F.lower(F.regexp_replace(F.substring_index("key", "/", 1), r"(?i)\.mp4$", "")))
    of = lambda role, c: F.when(F.col("role") == role, c)
    held = clips.groupBy("place", "segment").agg(
        F.count(of("image", F.lit(1))).alias("num_frames"), F.count(of("lines", F.lit(1))).alias("num_lines"), F.min(of("image", F.col("path"))).alias("image_path"),
        F.min(of("truth", F.col("path"))).alias("mask"), F.min(of("test_truth", F.col("path"))).alias("test_mask"),
    ).where("num_frames + num_lines > 0")
    segments = held.groupBy("segment").agg(F.max(F.struct("place", "num_frames", "num_lines", "image_path", "mask", "test_mask")).alias("s"), (F.count("*") > 1).alias("ambiguous")).select("segment", "s.*", "ambiguous")
    mask = F.coalesce("mask", "test_mask")
    folder = F.regexp_replace(mask, "/[^/]*$", "")
    split = F.when(F.col("mask").isNull() & F.col("test_mask").isNotNull(), "test").otherwise("train/val")
    segments = segments.select(F.lit("culane").alias("dataset"), F.col("segment").alias("key"), "image_path", split.alias("split"), folder.alias("truth_path"), "num_frames", "num_lines", "ambiguous")

    key = F.when(F.col("dataset") == "culane", F.lower(_stem(F.col("file_name"), "mp4"))).otherwise(_stem(F.col("file_name"), "jpg"))
    out = names.withColumn("key", key).join(single.unionByName(segments), ["dataset", "key"], "left")
    image, made = F.col("image_path").isNotNull(), F.col("truth_path").isNotNull()
    truth_found = made | (F.coalesce("num_lines", F.lit(0)) > 0)
    note = (
        F.when(F.col("dataset") == "tusimple", "bare numeric id without a path: unresolved")
        .when(F.col("dataset") == "culane", F.when(image, "a segment, not a single frame").when(F.col("split").isNotNull(), "segment without frames").otherwise("segment not found under any driver"))
        .when(~image, "image not found")
        .when(made, "")
        .when(F.col("split") == "test", "test split has no truth")
        .otherwise("truth missing")
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("dataset"))
    return out.select(*names.columns, "image_path", "split", "truth_path", kind.alias("kind"), image.alias("image_found"), truth_found.alias("truth_found"), "num_frames", "num_lines", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), note.alias("note"))
