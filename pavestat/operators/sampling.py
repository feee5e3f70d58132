"""Samples drawn until tags are covered, as counters that are merged, not run row by row.

Every dataset's pool stands in a seeded order and is taken by chunks, datasets in turn. After
each chunk a dataset ends if all wanted tags have enough samples (coverage), if for
``patience`` samples no tag has just reached its target (stalled), at the ``cap``, or with its
pool. What decides are sums: samples per chunk, samples per tag and chunk, and where in its
chunk a tag reaches its target; running sums of them give the counters at the end of each
chunk, and with them the first chunk that ends the dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import stop_reason, tags
from .order import numbered, same_keys


def coverage_sample(
    df: DataFrame,
    dataset: str,
    key: str,
    labels: str,
    readable: Column,
    wanted: Sequence[str],
    seed: int = 0,
    per_tag: int = 50,
    total: int = 500,
    patience: int = 600,
    cap: int = 5000,
    chunk: int = 50,
    done: DataFrame | None = None,
) -> DataFrame:
    """The rows that are drawn: ``dataset, key, chunk, readable, reason``, with ``reason`` that
    of their dataset's end. ``readable`` tells rows that can be tagged: others are looked at,
    but count for nothing. ``done(dataset, key, labels)`` are samples of earlier runs: they are
    not drawn again, and counters begin with them. Each dataset draws one chunk at least,
    unless the earlier samples end it. Tags outside ``wanted``, repeated ones and null lists
    count for nothing; a null dataset is one. ``per_tag`` is 1 or more."""
    if per_tag < 1 or chunk < 1:
        raise ValueError("per_tag and chunk are 1 or more")
    own_tags = F.array_intersect(tags(F.col(labels)), F.array(*map(F.lit, wanted)))
    pool = df
    if done is not None:
        gone = done.select(F.col(dataset).alias("d"), F.col(key).alias("k"))
        pool = df.join(gone, F.col(dataset).eqNullSafe(F.col("d")) & (F.col(key) == F.col("k")), "left_anti")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = pool.select(F.col(dataset).alias("dataset"), F.col(key).alias("key"), own_tags.alias("tags"), F.coalesce(readable, F.lit(False)).alias("readable"), order.alias("h"))
    placed = numbered(rows, ["dataset", "h", "key"], ["dataset"]).withColumn("chunk", F.floor(F.col("position") / chunk))
    first = done if done is not None else df.limit(0)
    first = first.select(F.col(dataset).alias("dataset"), own_tags.alias("tags"))
    had = first.groupBy("dataset").agg(F.count("*").alias("n0"))
    had_tags = first.select("dataset", F.explode("tags").alias("tag")).groupBy("dataset", "tag").agg(F.count("*").alias("c0"))

    def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        """All of ``left``, with what ``right`` has for its keys."""
        named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return left.join(named, on, "left").drop(*[f"__{k}" for k in keys])

    upto = Window.partitionBy("dataset").orderBy("chunk")  # a row per chunk
    sums = placed.groupBy("dataset", "chunk").agg(F.count_if("readable").alias("c"))
    sums = beside(sums, had, ["dataset"]).withColumn("n0", F.coalesce("n0", F.lit(0))).withColumn("n", F.col("n0") + F.sum("c").over(upto))
    # the chunk in which a tag reaches its target, and as which of its samples there
    tagged = placed.where("readable").select("dataset", "chunk", F.explode("tags").alias("tag")).groupBy("dataset", "tag", "chunk").agg(F.count("*").alias("c"))
    tagged = tagged.withColumn("upto", F.sum("c").over(Window.partitionBy("dataset", "tag").orderBy("chunk")))
    tagged = beside(tagged, had_tags, ["dataset", "tag"]).withColumn("need", per_tag - F.coalesce("c0", F.lit(0)))
    crossed = tagged.where("need > 0 and upto >= need and upto - c < need").select("dataset", "tag", "chunk", (F.col("need") - F.col("upto") + F.col("c")).alias("nth"))
    inside = same_keys(placed.where("readable").select("dataset", "chunk", "position", "tags"), crossed, ["dataset", "chunk"])
    by = Window.partitionBy("dataset", "chunk", "tag").orderBy("position")  # rows of one chunk
    has = F.array_contains("tags", F.col("tag"))
    inside = inside.select("dataset", "chunk", "nth", has.alias("has"), F.row_number().over(by).alias("sample"), F.sum(has.cast("int")).over(by).alias("k")).where("has and k = nth")
    hits = inside.groupBy("dataset", "chunk").agg(F.count("*").alias("hits"), F.max("sample").alias("sample"))
    reached = had_tags.where(F.col("c0") >= per_tag).groupBy("dataset").agg(F.count("*").alias("reached0"))
    state = beside(beside(sums, hits, ["dataset", "chunk"]), reached, ["dataset"])
    met = F.coalesce("reached0", F.lit(0)) + F.sum(F.coalesce("hits", F.lit(0))).over(upto)
    progress = F.greatest(F.col("n0"), F.max(F.col("n") - F.col("c") + F.col("sample")).over(upto))
    left = F.max("chunk").over(Window.partitionBy("dataset")) - F.col("chunk")
    state = state.select("dataset", "chunk", "n", met.alias("met"), progress.alias("progress"), left.alias("left"))
    reason = stop_reason(F.col("n"), F.when(F.col("met") >= len(set(wanted)), per_tag).otherwise(0), F.col("n") - F.col("progress"), F.col("left"), per_tag=per_tag, total=total, patience=patience, cap=cap)
    ends = state.withColumn("reason", reason).where("reason is not null").groupBy("dataset").agg(F.min(F.struct("chunk", "reason")).alias("end"))
    ends = ends.select("dataset", F.col("end.chunk").alias("last"), F.col("end.reason").alias("reason"))
    if done is not None:  # what the earlier samples end takes nothing
        start = beside(had, reached, ["dataset"])
        at_once = stop_reason(F.col("n0"), F.when(F.coalesce("reached0", F.lit(0)) >= len(set(wanted)), per_tag).otherwise(0), F.lit(0), F.lit(1), per_tag=per_tag, total=total, patience=patience, cap=cap)
        ends = beside(ends, start.where(at_once.isNotNull()).select("dataset", F.lit(True).alias("over")), ["dataset"]).where("over is null").drop("over")
    return same_keys(placed.select("dataset", "key", "chunk", "readable"), ends, ["dataset"]).where("chunk <= last").drop("last")
