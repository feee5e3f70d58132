"""Sinks of records and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..operators import frames, relational
from ..operators.order import numbered


def flat(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Scalars only, ``first`` in front, then by name; ``metadata`` becomes columns
    ``metadata.<key>``: its fields, or, for a map, the keys that occur."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    own = [c for c in first if c in plain]
    columns = [F.col(f"`{c}`") for c in [*own, *sorted(set(plain) - set(own))]]
    if "metadata" in df.columns and "metadata" not in plain:
        kind = df.schema["metadata"].dataType
        keys = kind.names if isinstance(kind, T.StructType) else sorted(r[0] for r in df.select(F.explode(F.map_keys("metadata"))).distinct().collect())
        columns += [F.col("metadata")[k].alias(f"metadata.{k}") for k in keys]
    return df.select(*columns)


def write_records(df: DataFrame, json_path: str, csv_path: str, first: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").json(json_path)
    flat(df, first).write.mode("overwrite").option("header", True).csv(csv_path)


def write_ranking(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "model")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def lane_manifest(df: DataFrame, lanes: str = "lanes", mask: str = "mask") -> DataFrame:
    """``df`` with ``lane_json`` (rows of the grid, x of each lane) and ``natural_gt``: from
    ``lanes`` where they are, else from the PNG ``mask``. ``df`` has ``height`` and
    ``width``; neither lanes nor mask gives nulls. ``mask`` is not kept."""
    own = frames.mask_to_lanes(df.withColumnRenamed(mask, "__mask"), "__mask").drop("reason", "__mask")
    own = frames.draw_lanes(own, lanes).drop("reason", "mask")
    xs = F.when(F.size(lanes) > 0, F.col("grid_xs")).otherwise(F.col("mask_xs"))
    kind = F.when(F.size(lanes) > 0, "lanes").when(F.col("mask_xs").isNotNull(), "mask")
    own = own.withColumn("lane_json", F.when(xs.isNotNull(), F.struct(E.grid(F.col("height"), 10).alias("h_samples"), xs.alias("lanes"))))
    return own.withColumn("natural_gt", kind).drop("grid_xs", "mask_xs")


def prediction_manifest(df: DataFrame, lanes: str = "lanes", scores: str = "scores", mask: str = "mask") -> DataFrame:
    """``lane_manifest`` with ``polylines``, each lane with its score in step: lanes of under
    two points go with their scores, and without scores each has a null one."""
    pairs = F.arrays_zip(F.col(lanes).alias("points"), F.coalesce(F.col(scores), F.array()).alias("score"))
    pairs = F.filter(F.slice(pairs, 1, F.greatest(F.size(lanes), F.lit(0))), lambda v: F.size(v["points"]) >= 2)
    own = df.withColumn("polylines", F.when(F.col(lanes).isNotNull(), F.transform(pairs, lambda v: F.struct(v["points"].alias("points"), v["score"].alias("score")))))
    own = own.withColumn(lanes, F.transform("polylines", lambda v: v["points"]))
    return lane_manifest(own, lanes, mask).drop(scores)


def output_manifest(df: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """``samples`` with ``metrics``: the records' scalars by first letter and number (``D``,
    ``I``, ``R``), others under ``core``; null where a sample has no record. A key should
    have one record."""
    groups: dict[str, list[str]] = {"core": [], "D": [], "I": [], "R": []}
    for f in df.schema:
        if f.name != key and not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            groups[f.name[0] if f.name[:1] in groups and f.name[1:2].isdigit() else "core"].append(f.name)
    parts = [F.struct(*[F.col(f"`{c}`") for c in names]).alias(g) for g, names in groups.items() if names]
    return samples.join(df.select(key, F.struct(*parts).alias("metrics")), key, "left")


def write_manifest(df: DataFrame, path: str, most: int | None = None, order: str = "sample_id") -> None:
    """A JSON line per sample; ``most`` keeps the first by ``order``."""
    (df if most is None else df.orderBy(order).limit(most)).write.mode("overwrite").json(path)


def write_ground_truth(df: DataFrame, path: str, dataset: str, order: Sequence[str] = ("sample_id",), most: int | None = None, step: int = 10) -> None:
    """One JSON document below ``path``: ``metadata`` and ``samples``, in order, of the first
    ``most``. ``df`` has a sample's fields as columns. Positions and JSON are made by many tasks;
    as the format is one document, one task writes it, a line at a time."""
    kept = numbered(df.select(*df.columns), list(order))
    kept = kept if most is None else kept.where(F.col("position") < most)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    lines = kept.select((F.col("position") + 1).alias("at"), F.concat(F.when(F.col("position") > 0, ",").otherwise(""), line).alias("value"))
    about = F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.count("*").alias("num_samples"), F.lit(step).alias("h_sample_step")))
    head = kept.agg(F.concat(F.lit('{"metadata": '), about, F.lit(', "samples": [')).alias("value")).select(F.lit(0).cast("long").alias("at"), "value")
    foot = df.sparkSession.createDataFrame([((1 << 62), "]}")], "at long, value string")
    head.unionByName(lines).unionByName(foot).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def model_table(rows: DataFrame, primary: str = "lane_f1") -> str:
    """Markdown of results by model and dataset, and of each model's means and consistency.
    Summed up in Spark; a row per run is formatted here."""
    metrics = ["lane_iou", "lane_f1", "lane_precision", "lane_recall"]
    say = lambda v: f"{v:.4f}" if isinstance(v, int | float) else "-"
    runs = rows.select("model", "dataset", "split", "num_images", *metrics).orderBy("model", "dataset").collect()
    means = rows.groupBy("model").agg(*[E.mean(F.col(m)).alias(m) for m in metrics], E.consistency(F.col(primary)).alias("consistency")).orderBy("model").collect()
    out = ["## Results", "", "| Model | Dataset | Split | Images | IoU | F1 | Precision | Recall |", "|---|---|---|--:|--:|--:|--:|--:|"]
    out += [f"| {r.model} | {r.dataset} | {r.split} | {r.num_images} | " + " | ".join(say(r[m]) for m in metrics) + " |" for r in runs]
    out += ["", "## Models", "", "| Model | IoU | F1 | Precision | Recall | Consistency |", "|---|--:|--:|--:|--:|--:|"]
    return "\n".join([*out, *["| " + " | ".join([r.model, *[say(r[m]) for m in metrics], say(r.consistency)]) + " |" for r in means]])


def write_ranked(df: DataFrame, path: str, metrics: Sequence[str], order: Sequence[str], by: Sequence[str] = ("dataset", "model"), k: int = 50) -> None:
    """The best and worst ``k`` rows of each group by each metric, and how many rows count."""
    for metric in metrics:
        relational.top_and_bottom(df, by, metric, k, order).write.mode("overwrite").partitionBy(*by, "side").parquet(f"{path}/{metric}")
    df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count(E.finite(F.col(m))).alias(m) for m in metrics]).write.mode("overwrite").parquet(f"{path}/counts")
