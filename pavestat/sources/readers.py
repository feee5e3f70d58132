"""Readers of lane datasets, manifests, records and runs, as DataFrames.

Lanes are ``array<array<struct<x double, y double>>>``; lanes of fewer than two points are
dropped. Small documents are read whole, one row per file; nothing is parsed on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import raster
from .json_array import elements

#: Default heights and widths of the datasets' images.
SIZES = {"tusimple": (720, 1280), "culane": (590, 1640), "curvelanes": (1440, 2560)}
#: Scenario by the first keyword that a list file's stem contains.
SCENARIOS = [
    ("normal", "clear"),
    ("night", "night"),
    ("hlight", "dazzle"),
    ("shadow", "shadow"),
    ("crowd", "crowded"),
    ("noline", "no_marking"),
    ("arrow", "arrow"),
    ("curve", "curve"),
    ("cross", "cross"),
]
#: Folders of CULane's masks, the preferred one first.
SEG_FOLDERS = ("laneseg_label_w16", "laneseg_label_w16_test")


def _sized(df: DataFrame, dataset: str) -> DataFrame:
    height, width = SIZES[dataset]
    return df.withColumns({"height": F.lit(height), "width": F.lit(width)})


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _lanes(lanes: Column) -> Column:
    return F.filter(lanes, lambda lane: F.size(lane) >= 2)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def tusimple(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that are no such record are skipped, points left of the image are
    no points. Values of x may be whole or not. An id has ``_`` for ``/``."""
    rows = spark.read.schema("raw_file string, lanes array<array<double>>, h_samples array<double>").option("mode", "DROPMALFORMED").json(path)
    seen = F.transform("lanes", lambda xs: F.filter(F.zip_with(xs, "h_samples", _point), lambda p: (p.x >= 0) & p.y.isNotNull()))
    rows = rows.where("raw_file is not null").select(F.replace("raw_file", F.lit("/"), F.lit("_")).alias("sample_id"), "raw_file", _lanes(seen).alias("lanes"))
    return _sized(rows, "tusimple")


def scenario(stem: Column) -> Column:
    found = F.lit(None).cast("string")
    for keyword, name in reversed(SCENARIOS):
        found = F.when(F.contains(stem, F.lit(keyword)), name).otherwise(found)
    return found


def culane_list(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """One frame per line of a list file: the first word, and the scenario by file name.
    With ``root``, the dataset's folder, also ``timeofday``, told for night, and
    ``mask_path`` of the first of ``SEG_FOLDERS`` that has the frame's mask, or null."""
    lines = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"))
    frame = F.regexp_replace(F.split(F.trim("value"), r"\s+")[0], "^/+", "")
    found = lines.where(F.trim("value") != "").select(frame.alias("sample_id"), scenario(F.col("stem")).alias("scenario"))
    if root is None:
        return found
    found = found.withColumn("timeofday", F.when(F.col("scenario") == "night", "night"))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(f"{root.rstrip('/')}/{{{','.join(SEG_FOLDERS)}}}")
    except AnalysisException:  # neither folder is there
        return found.withColumn("mask_path", F.lit(None).cast("string"))
    part = lambda k: F.regexp_extract("path", rf"/({'|'.join(SEG_FOLDERS)})/(.*)$", k)
    masks = files.groupBy(part(2).alias("name")).agg(F.min_by("path", F.array_position(F.array(*map(F.lit, SEG_FOLDERS)), part(1))).alias("mask_path"))
    return found.withColumn("name", F.replace("sample_id", F.lit(".jpg"), F.lit(".png"))).join(masks, "name", "left").drop("name")


def culane_lines(spark: SparkSession, path: str) -> DataFrame:
    """``*.lines.txt`` below ``path``: a lane per line, ``x y x y ...``; lines with an odd
    count or a word that is no number are skipped."""

    def lane(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1), lambda i: _point(F.get(values, 2 * i), F.get(values, 2 * i + 1)))

    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda v: F.split(F.trim(v), r"\s+")), lambda v: F.size(v) >= 4)
    numbers = F.filter(F.transform(lines, lambda v: F.transform(v, _number)), lambda v: (F.size(v) % 2 == 0) & ~F.exists(v, lambda x: x.isNull()))
    rows = _documents(spark, path, "*.lines.txt").select(F.regexp_replace("file", r"\.lines\.txt$", "").alias("sample_id"), F.transform(numbers, lane).alias("lanes"))
    return _sized(rows, "culane")


def curvelane_text(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the ``lanes`` of a label's text."""
    kind = "struct<Lines: array<array<struct<x: string, y: string>>>>"
    lanes = F.transform(F.from_json(text, kind)["Lines"], lambda lane: F.filter(F.transform(lane, lambda p: _point(_number(p.x), _number(p.y))), lambda p: p.x.isNotNull() & p.y.isNotNull()))
    return df.withColumn("lanes", F.coalesce(_lanes(lanes), F.array().cast("array<array<struct<x: double, y: double>>>")))


def curvelanes(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``Lines``: lanes of points whose values are strings; what is no number is dropped."""
    rows = curvelane_text(_documents(spark, path, pattern), "value")
    return _sized(rows.select(F.col("file").alias("sample_id"), "lanes"), "curvelanes")


def image_pairs(spark: SparkSession, images: str, masks: str, attributes: str | None = None) -> DataFrame:
    """Images with the mask of the same stem; contents are not read. Raises without a pair.
    With ``attributes``, ``weather, scene, timeofday`` of the JSON of the same stem there,
    null without such a file or if it is damaged."""

    def listed(path: str, name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("sample_id"), F.col("path").alias(name))

    pairs = listed(images, "image_path").join(listed(masks, "mask_path"), "sample_id")
    if pairs.isEmpty():
        raise ValueError(f"no image of {images} has a mask in {masks}")
    if attributes is None:
        return pairs
    told = [F.get_json_object("value", f"$.attributes.{x}").alias(x) for x in ("weather", "scene", "timeofday")]
    found = _documents(spark, attributes, "*.json").select(F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1).alias("sample_id"), *told)
    return pairs.join(found, "sample_id", "left")


def _samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of manifests (an object with ``samples``, or a list) as JSON text, each
    manifest by as many tasks as it has byte ranges."""
    return elements(spark, path).select(F.regexp_replace("file", "[^/]*$", "").alias("base"), "position", F.col("element").alias("sample"))


def _path(name: str) -> Column:
    found = F.get_json_object("sample", name)
    return F.when(found.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"), found).otherwise(F.concat("base", found))


def manifest(spark: SparkSession, path: str, lifted: tuple[str, ...] = ()) -> DataFrame:
    """Samples in order; relative masks stand against the manifest's folder; ``lifted``
    fields come from ``ground_truth`` or else its ``meta``."""
    more = [F.coalesce(F.get_json_object("sample", f"$.ground_truth.{x}"), F.get_json_object("sample", f"$.ground_truth.meta.{x}")).alias(x) for x in lifted]
    return _samples(spark, path).select("position", F.get_json_object("sample", "$.sample_id").alias("sample_id"), F.get_json_object("sample", "$.image_path").alias("image_path"), _path("$.ground_truth.mask_path").alias("mask_path"), F.get_json_object("sample", "$.meta").alias("meta"), *more)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predicted lanes with their scores in step; points are ``{x, y}`` or ``[x, y]``."""
    raw = F.from_json(F.get_json_object("sample", "$.prediction.polylines"), "array<array<string>>")
    scores = F.transform(F.from_json(F.get_json_object("sample", "$.prediction.scores"), "array<string>"), _number)

    def point(p: Column) -> Column:
        at = lambda key, k: _number(F.coalesce(F.get_json_object(p, f"$.{key}"), F.get_json_object(p, f"$[{k}]")))
        return _point(at("x", 0), at("y", 1))

    lanes = F.transform(raw, lambda lane: F.filter(F.transform(lane, point), lambda p: _finite(p.x) & _finite(p.y)))
    both = F.filter(F.transform(lanes, lambda lane, i: F.struct(lane.alias("lane"), F.get(scores, i).alias("score"))), lambda z: F.size(z.lane) >= 2)
    rows = _samples(spark, path).select("*", both.alias("both"), F.get_json_object("sample", "$.prediction.lane_json").alias("lane_json"), _path("$.prediction.mask_path").alias("mask_path"))
    source = F.when(F.size("both") > 0, "polyline").when(F.col("lane_json").isNotNull(), "lane_json").when(F.col("mask_path").isNotNull(), "mask").otherwise("unavailable")
    kept = F.transform("both", lambda z: z.score)
    return rows.select("position", F.get_json_object("sample", "$.sample_id").alias("sample_id"), F.transform("both", lambda z: z.lane).alias("lanes"), F.when(F.exists(kept, _finite), kept).alias("scores"), "lane_json", "mask_path", source.alias("geometry_source"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Metric records of JSON lines, or of CSV with all values as strings."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.json(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Result files of a folder; files without ``metrics.lane_iou`` are skipped."""
    names = ["lane_iou", "lane_f1", "lane_precision", "lane_recall"]
    found = _documents(spark, path, "*.json").select(*[F.get_json_object("value", f"$.{x}").alias(x) for x in ("model", "dataset", "split")], *[_number(F.get_json_object("value", f"$.metrics.{x}")).alias(x) for x in names])
    return found.where("lane_iou is not null")


def tag_run(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tags; bad lines are skipped and an id's last line counts."""
    kind = "struct<sample_id: string, dataset: string, error: string, predicted_tags: struct<by_dimension: map<string, array<string>>>>"
    lines = spark.read.text(path).select(F.from_json("value", kind).alias("r"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    return lines.where("r.sample_id is not null").groupBy(F.col("r.sample_id").alias("id")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV by the delimiter that the first line has most of; a comma where it has none."""
    first = spark.read.text(path).first()
    return spark.read.option("header", True).option("sep", max(",;\t|", key=(first[0] if first else "").count)).csv(path)


def frozen_config(spark: SparkSession, path: str) -> dict | None:
    """A small JSON object; None where there is none, an error where it is no object."""
    try:
        rows = spark.read.option("wholetext", True).text(path).take(1)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = json.loads(rows[0][0]) if rows else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def resolve_images(names: DataFrame, images: DataFrame, masks: DataFrame, name: str = "file_name", order: tuple[str, ...] = ("val", "train", "test")) -> DataFrame:
    """``names`` with the image, split and mask of the same stem. ``images`` and ``masks``
    have ``path``, in a folder named by the split; of several images that of the first
    split in ``order`` counts (then the least path), and only a mask of that split.
    ``note`` tells what is missing. Repeated names each get their row."""

    def listed(df: DataFrame, as_: str) -> DataFrame:
        parts = F.split("path", "/")
        found = df.select(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), F.try_element_at(parts, F.lit(-2)).alias("split"), F.col("path").alias(as_))
        return found.where(F.col("split").isin(*order))

    rank = F.array_position(F.lit(list(order)), F.col("split"))
    first = listed(images, "image_path").groupBy("stem").agg(F.min_by(F.struct("split", "image_path"), F.struct(rank, "image_path")).alias("image")).select("stem", "image.*")
    mask = listed(masks, "mask_path").groupBy("stem", "split").agg(F.min("mask_path").alias("mask_path"))
    stem = F.regexp_replace(F.col(name), r"(?i)\.jpg$", "")
    out = names.withColumn("stem", stem).join(first.join(mask, ["stem", "split"], "left"), "stem", "left").drop("stem")
    note = F.when(F.col("image_path").isNull(), "image not found").when(F.col("mask_path").isNull(), "mask missing").otherwise("")
    return out.withColumn("note", note)


def strided(frames: DataFrame, segment: str, order: str, stride: int = 10) -> DataFrame:
    """Each ``stride``-th frame of a segment by ``order``, from the first. A segment is one
    clip."""
    at = F.row_number().over(Window.partitionBy(segment).orderBy(order))
    return frames.withColumn("__at", at).where((F.col("__at") - 1) % stride == 0).drop("__at")


#: Different tags of a table of tags at most: each is a column.
MOST_TAGS = 4096


def tag_table(tags: DataFrame, dimensions: list[str], order: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """``sample_id`` and tags by dimension to a wide table: a column of joined tags for
    each dimension, and a 0/1 column for each tag, by dimension and as they first appear when
    rows stand by ``order``. The tags that occur are collected: a vocabulary, not data.
    Repeated ids, over ``MOST_TAGS`` tags, or a tag with the name of another column raise
    ValueError."""
    by = F.col("predicted_tags.by_dimension")
    again = tags.groupBy("sample_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"repeated sample {again[0][0]!r}")
    column = {d: "tag_" + d.lower().replace(" & ", "_").replace(" ", "_").replace("/", "_") for d in dimensions}
    wide = tags.select("sample_id", "dataset", *[F.array_join(F.coalesce(by[d], F.array()), "; ").alias(c) for d, c in column.items()], F.flatten(F.array(*[F.coalesce(by[d], F.array().cast("array<string>")) for d in dimensions])).alias("__all"))
    seen = tags.select(F.struct(*order).alias("row"), F.explode(by).alias("d", "ts")).select("row", "d", F.posexplode("ts").alias("at", "t")).where("t is not null")
    pairs = seen.groupBy("d", "t").agg(F.min(F.struct("row", "at")).alias("first")).limit(MOST_TAGS + 1)
    found = pairs.orderBy("first", "d").select("d", "t").collect()
    if len(found) > MOST_TAGS:
        raise ValueError(f"over {MOST_TAGS} tags")
    words = list(dict.fromkeys(r["t"] for d in dimensions for r in found if r["d"] == d))
    if clash := set(words) & set(wide.columns):
        raise ValueError(f"tags named like columns: {sorted(clash)}")
    return wide.select("*", *[F.array_contains("__all", t).cast("int").alias(t) for t in words]).drop("__all")


#: Readers by the name of their dataset.
DATASETS: dict[str, Callable[..., DataFrame]] = {"tusimple": tusimple, "culane": culane_lines, "curvelanes": curvelanes, "bdd100k_lane": image_pairs}


def dataset(spark: SparkSession, name: str, *paths: str, **options) -> DataFrame:
    """The samples of a dataset by its name; KeyError, with the names there are, for another."""
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    return DATASETS[name](spark, *paths, **options)


def inspect(df: DataFrame, n: int = 5, order: str = "sample_id") -> tuple[int, DataFrame]:
    """The number of samples, and the first ones with their size and number of lanes."""
    lanes = F.size("lanes") if "lanes" in df.columns else F.lit(None).cast("int")
    shown = df.orderBy(order).limit(n).select(order, *[c for c in ("width", "height") if c in df.columns], lanes.alias("n_lanes"))
    return df.count(), shown


def per_image_results(spark: SparkSession, folders: Sequence[str], suffixes: Sequence[str] = ("_per_image", "_per_image_metrics")) -> DataFrame:
    """Rows of all ``<folder>/per_image/*.csv`` with ``model`` and ``dataset`` by their columns,
    else by the file's name (the first word is the model); of a model and dataset that several
    folders have, the rows of the last folder. Folders that are not there are passed over."""
    found = None
    for rank, folder in enumerate(folders):
        try:
            rows = spark.read.option("header", True).option("pathGlobFilter", f"*{{{','.join(suffixes)}}}.csv").csv(f"{folder.rstrip('/')}/per_image")
        except AnalysisException:
            continue
        if not rows.columns:
            continue
        name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), rf"({'|'.join(sorted(suffixes, key=len, reverse=True))})\.csv$", "")
        parts = {"model": F.substring_index(name, "_", 1), "dataset": F.regexp_replace(name, "^[^_]*_?", "")}
        rows = rows.withColumns({c: F.coalesce(F.col(c), f) if c in rows.columns else f for c, f in parts.items()}).withColumn("__rank", F.lit(rank))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no results of images in {list(folders)}")
    # a row per model and dataset: small, Catalyst broadcasts it
    last = found.groupBy("model", "dataset").agg(F.max("__rank").alias("__last"))
    return found.join(last, ["model", "dataset"]).where("__rank = __last").drop("__rank", "__last")


def first_readable(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``path.json``, or, if that is not there, of ``path.csv``."""
    try:
        return spark.read.option("multiLine", True).json(f"{path}.json")
    except AnalysisException:
        return records(spark, f"{path}.csv")


def moved(path: Column, roots: Mapping[str, str]) -> Column:
    """A path of another machine under this one's root: the first root that it begins with."""
    out = path
    for old, new in reversed(list(roots.items())):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def drawn_samples(spark: SparkSession, n: int = 50, height: int = 720, width: int = 1280, seed: int = 0) -> DataFrame:
    """Synthetic frames for a trial run, each by a seed of its own: a road with three bent
    lanes, its mask, and a prediction with a band missing (each third), shifted (each fifth)
    and with stray pixels. Images and masks are PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in rows["id"].tolist():
                rng, y = np.random.default_rng([seed, i]), np.arange(height * 7 // 24, height * 65 // 72)
                image = np.full((height, width, 3), 58, np.uint8)
                image[: height // 4] = 190
                gt = np.zeros((height, width), bool)
                for start in (0.28, 0.41, 0.54):
                    x = (start * width + 0.00055 * (y - 0.6 * height) ** 2 + rng.normal(0, 1, len(y))).astype(int)
                    for d in range(-5, 6):
                        gt[y, np.clip(x + d, 0, width - 1)] = True
                image[gt] = 225
                pred = gt.copy()
                if i % 3 == 0:
                    pred[height * 26 // 72 : height * 33 // 72] = False
                pred = np.roll(pred, 3, axis=1) if i % 5 == 0 else pred
                pred |= rng.random(gt.shape) < 0.001
                row = {"sample_id": f"dry_{i:04d}", "image": raster.write_png(image), "gt": raster.write_png(gt * np.uint8(255)), "pred": raster.write_png(pred * np.uint8(255)), "weather": ("rainy", "clear")[i % 2 == 0], "timeofday": "daytime", "condition": ("wet", "clear")[i % 2 == 0], "height": height, "width": width}
                yield pd.DataFrame([row])

    return spark.range(n).repartition(max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(run, "sample_id string, image binary, gt binary, pred binary, weather string, timeofday string, condition string, height int, width int")


def json_object(text: Column) -> Column:
    """The first object in a model's answer, fences or words around it, as text; null without
    a whole one. Braces are counted along the text."""
    start = F.instr(text, "{")
    cut = F.substring(text, start, F.length(text))
    chars = F.split(cut, "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when((s["end"] == 0) & (c == "}") & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"]).alias("end"),
        ),
    )
    found = F.substring(cut, 1, state["end"])
    whole = (start > 0) & (state["end"] > 0)
    return F.when(whole & F.try_parse_json(found).isNotNull(), found)


def answered_tags(text: Column, dimension: str, known: Sequence[str]) -> Column:
    """Tags of a dimension in a model's answer: ``tags``, those that are known, in their own
    spelling, once each; ``unmatched``; and ``why``. An answer is a list, a word, or an object
    with ``tags`` and ``why``."""
    body = json_object(text)
    own = F.get_json_object(body, f"$['{dimension}']")
    listed = F.coalesce(F.get_json_object(own, "$.tags"), F.when(~F.startswith(F.ltrim(own), F.lit("{")), own))
    words = F.when(F.startswith(F.ltrim(listed), F.lit("[")), F.from_json(listed, "array<string>")).otherwise(F.array(listed))
    words = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull() & (F.trim(w) != ""))
    spelled = F.create_map(*[x for k in known for x in (E.normal_tag(F.lit(k)), F.lit(k))])
    hits = F.transform(words, lambda w: F.struct(F.try_element_at(spelled, E.normal_tag(w)).alias("known"), w.alias("said")))
    tags = F.array_distinct(F.transform(F.filter(hits, lambda h: h["known"].isNotNull()), lambda h: h["known"]))
    return F.struct(tags.alias("tags"), F.transform(F.filter(hits, lambda h: h["known"].isNull()), lambda h: h["said"]).alias("unmatched"), F.get_json_object(own, "$.why").alias("why"))
