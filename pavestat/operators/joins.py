"""Joins of samples, predictions, tags and records. All are equi-joins; sides are never
broadcast by hand, Catalyst knows their sizes."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered
from .relational import pick, unique


def aligned(gt: DataFrame, pred: DataFrame, key: str = "sample_id", order: Sequence[str] = (), readable: Column | None = None, most: int | None = None) -> DataFrame:
    """Samples with their prediction, inner; the last row of an id counts if ``order`` tells
    rows apart. Of samples the first ``most`` are looked at; those that are not ``readable`` go."""
    own = gt if most is None else gt.orderBy(*(order or [key])).limit(most)
    told = last(pred, key, order) if order else pred
    joined = own.join(told, key)
    return joined if readable is None else joined.where(readable)


def paired(gt: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    """All samples; ``predicted`` tells whether there is a prediction. Its columns are null if
    not, which the kernels take for an empty mask: the sample still counts."""
    return gt.join(pred.withColumn("__there", F.lit(True)), key, "left").withColumn("predicted", F.coalesce("__there", F.lit(False))).drop("__there")


def last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return pick(df, [key], [F.desc(c) for c in order])


def scored_pairs(pred: DataFrame, gt: DataFrame, pred_mask: str, gt_mask: str, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Predictions with the ground truth of the same id where both masks are there, and one
    row of counts, ``processed`` and ``skipped``."""
    joined = pred.join(gt, key, "left")
    both = F.col(pred_mask).isNotNull() & F.col(gt_mask).isNotNull()
    return joined.where(both), joined.agg(F.count_if(both).alias("processed"), F.count_if(~both).alias("skipped"))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Columns but ``keep`` with ``prefix_`` in front, if they do not begin so already."""
    return df.select(*keep, *[F.col(f"`{c}`").alias(c if c.startswith(prefix) else f"{prefix}_{c}") for c in df.columns if c not in {*keep, *drop}])


def combined(base: DataFrame, firsts: dict[str, tuple[DataFrame, str, Sequence[str]]], uniques: dict[str, tuple[DataFrame, str]], drop: Sequence[str] = ()) -> DataFrame:
    """``base`` with tables beside it, their columns prefixed. ``firsts``: by prefix, table,
    key and the order that tells which row of a key stays. ``uniques``: by prefix, table and
    key, which must not repeat: the query fails if one does."""
    for prefix, (df, key, order) in firsts.items():
        base = base.join(prefixed(pick(df, [key], [F.asc(c) for c in order]), prefix, [key], drop), key, "left")
    for prefix, (df, key) in uniques.items():
        base = base.join(prefixed(unique(df, [key]), prefix, [key], drop), key, "left")
    return base


def one_hot_group(df: DataFrame, column: str, groups: Sequence[str], missing: str) -> DataFrame:
    """``column`` replaced by a 0/1 column for each group; null counts as ``missing``."""
    own = F.lower(F.coalesce(column, F.lit(missing)))
    return df.withColumns({f"{column}_{g}": (own == g).cast("int") for g in groups}).drop(column)


def numeric_only(df: DataFrame, but: Sequence[str]) -> DataFrame:
    """``df``, or ValueError if a column beside ``but`` is no number."""
    odd = [n for n, t in df.dtypes if n not in but and t not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") and not t.startswith("decimal")]
    if odd:
        raise ValueError(f"columns that are no numbers: {odd}")
    return df


def image_key(df: DataFrame, name: str = "image_name", key: str = "sample_id") -> DataFrame:
    return df.withColumn(key, F.regexp_replace(name, r"\.jpg$", ""))


def updated(base: DataFrame, tags: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` from ``tags`` where it has the key, else its own (null if it
    has none); ``updated`` tells which."""
    new = tags.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = base.join(new, key, "left").withColumn("updated", F.coalesce("__hit", F.lit(False)))
    for c in columns:
        out = out.withColumn(c, F.when(F.col("updated"), F.col(f"__{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)))
    return out.drop("__hit", *[f"__{c}" for c in columns])


def verdicts(truth: DataFrame, run: DataFrame, keys: Sequence[str], truth_tags: str, run_tags: str) -> DataFrame:
    """Human verdicts that are sure, with a run's tags; what the run does not have is an empty
    list. ``truth`` has ``unsure``."""
    sure = truth.where(~F.coalesce("unsure", F.lit(False)) & F.col(truth_tags).isNotNull())
    empty = F.array().cast("array<string>")
    return sure.join(run.select(*keys, F.col(run_tags).alias("__got")), list(keys), "left").withColumn(run_tags, F.coalesce("__got", empty)).drop("__got")


def tag_scores(df: DataFrame, group: Sequence[str], truth: str, got: str) -> DataFrame:
    """Per group, and over all (nulls for the group): rows, exact share, mean Jaccard, tags
    in both, only in one, only in the other, and precision, recall and F1, 0 where undefined."""
    a, b = F.array_distinct(F.coalesce(got, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(truth, F.array().cast("array<string>")))
    hit, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    own = df.select(*group, hit.alias("i"), union.alias("u"), F.size(a).alias("a"), F.size(b).alias("b"))
    sums = own.rollup(*group) if group else own.groupBy()
    out = sums.agg(
        F.count("*").alias("n"), F.avg((F.col("i") == F.col("u")).cast("double")).alias("exact"), F.avg(F.coalesce(F.try_divide(F.col("i"), F.col("u")), F.lit(1.0))).alias("jaccard"),
        F.sum("i").alias("tp"), F.sum(F.col("a") - F.col("i")).alias("fp"), F.sum(F.col("b") - F.col("i")).alias("fn"),
    )
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def subset(tagged: DataFrame, standard: DataFrame, parts: Sequence[Column], key: str = "sample_id", meta: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of ``standard`` whose id is made of ``parts`` of a tagged row, with the tagged
    row's ``meta``; and the ids that it does not have."""
    wanted = tagged.select(F.concat_ws("_", *parts).alias(key), *[F.col(c).alias(f"tagged_{c}") for c in meta])
    return standard.join(wanted, key), wanted.join(standard.select(key), key, "left_anti").select(key)


def side_by_side(rankings: dict[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Rankings of several models, rows that all of them have, columns by model."""
    named = [df.select(key, *[F.col(c).alias(f"{model}_{c}") for c in columns]) for model, df in rankings.items()]
    return functools.reduce(lambda a, b: a.join(b, key), named)


def positional(samples: DataFrame, records: DataFrame, order: Sequence[str], record_order: Sequence[str]) -> DataFrame:
    """The n-th sample with the n-th record, if there are as many; else samples with null
    records. Numbers come from range partitions' counts, so no task orders all."""
    a, b = numbered(samples, order), numbered(records, record_order)
    same = samples.count() == records.count()
    b = b if same else b.where(F.lit(False))
    clash = [c for c in records.columns if c in samples.columns]
    return a.join(b.drop(*clash), "position", "left")


def by_directory(df: DataFrame, rank: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of results of one key in several folders those of the last folder, all its rows."""
    top = F.max(rank).over(Window.partitionBy(*keys))
    return df.withColumn("__top", top).where(F.col(rank) == F.col("__top")).drop("__top").dropDuplicates([*keys, *order])


def common(*frames: DataFrame, key: str) -> DataFrame:
    """Ids that all frames have."""
    return functools.reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of all; columns that one does not have are null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
