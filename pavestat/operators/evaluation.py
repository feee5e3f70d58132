"""Sums of detection, confusion and lanes, roll-ups of runs, profiles of columns, closings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .order import percentiles, same_keys

#: Keeps a ratio of sums of nothing at 0.
TINY = 1e-12


def detection(df: DataFrame, group: Sequence[str], score: Column, missed: Column, total: Column, threshold: float, high: float, fallback: Column | None = None) -> DataFrame:
    """Per group: ``images``; ``eligible``, those with a finite score; ``available``, their share, and
    ``fallbacks``, the share of the eligible for which ``fallback`` holds; ``rate``, the share of
    all images over ``threshold``; mean, spread and median score; ``pooled`` misses of eligible
    images; ``any_high``, whether a score is over ``high``."""
    own = df.select(*group, E.finite(score).alias("s"), missed.alias("m"), total.alias("t"), (F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))).alias("f"))
    s = F.col("s")
    sums = own.groupBy(*group).agg(
        F.count("*").alias("images"), F.count(s).alias("eligible"), E.ratio(F.count(s), F.count("*")).alias("available"), E.ratio(F.count_if(s.isNotNull() & F.col("f")), F.count(s)).alias("fallbacks"),
        F.avg(F.when(s > threshold, 1.0).otherwise(0.0)).alias("rate"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("spread"), E.pooled(F.col("m"), F.col("t"), s.isNotNull()).alias("pooled"), F.bool_or(s > high).alias("any_high"),
    )
    middle = percentiles(own, group, s, [0.5]).withColumnRenamed("q0", "median")
    if not group:
        return sums.join(F.broadcast(middle), how="left")  # one row each
    named = middle.withColumnsRenamed({g: f"__{g}" for g in group})
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return sums.join(named, on, "left").drop(*[f"__{g}" for g in group])


def confusion(df: DataFrame, truth: Column, got: Column, group: Sequence[str] = ()) -> DataFrame:
    """Per group ``tp, fp, fn, tn``, and of their sums precision, recall, IoU of the class and of
    what is left, their mean, F1 and accuracy; rows where a side is null are out. Ratios of
    nothing are 0."""
    t, g = truth.cast("boolean"), got.cast("boolean")
    both = t.isNotNull() & g.isNotNull()
    c = df.groupBy(*group).agg(F.count_if(both & t & g).alias("tp"), F.count_if(both & ~t & g).alias("fp"), F.count_if(both & t & ~g).alias("fn"), F.count_if(both & ~t & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: a / (b + TINY)
    iou, other = ratio(tp, tp + fp + fn), ratio(tn, tn + fp + fn)
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "iou": iou, "iou_other": other, "miou": (iou + other) / 2, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def lane_totals(df: DataFrame, found: str, wrong: str, missed: str, accuracy: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group found, wrong and missed lanes summed before the ratios, 0 where undefined; line
    accuracies averaged over images, 0 of none."""
    s = df.groupBy(*group).agg(*[F.sum(c).alias(n) for c, n in ((found, "tp"), (wrong, "fp"), (missed, "fn"))], F.count("*").alias("n"), F.coalesce(F.avg(accuracy), F.lit(0.0)).alias("accuracy"))
    p, r = (F.coalesce(E.ratio(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(E.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def rollup(df: DataFrame, outer: str, inner: str, value: str, quartiles_of: str) -> DataFrame:
    """Per ``outer``: how many ``inner`` groups it has, the mean of their means of ``value``, and
    the quartiles ``q0`` to ``q2`` of ``quartiles_of`` over all rows."""
    means = df.groupBy(outer, inner).agg(F.avg(value).alias("__mean")).groupBy(outer).agg(F.count("*").alias("groups"), F.avg("__mean").alias("mean_of_means"))
    return same_keys(means, percentiles(df, [outer], F.col(quartiles_of), [0.25, 0.5, 0.75]), [outer])


def profile(df: DataFrame, group: Sequence[str], value: str, levels: str) -> DataFrame:
    """Per group: rows, the share without a finite value, whether all that is there is a number
    (``kind``), its least and greatest, quartiles and spread, and the different ``levels``."""
    own, text = df.withColumn("__x", E.finite(F.col(value))), F.col(value).cast("string")
    x = F.col("__x")
    kind = F.when(F.count(text) == 0, "empty").when(F.count(text) == F.count(x), "numeric").when(F.count(x) == 0, "text").otherwise("mixed")
    sums = own.groupBy(*group).agg(F.count("*").alias("n"), (1 - E.ratio(F.count(x), F.count("*"))).alias("missing"), kind.alias("kind"), F.countDistinct(levels).alias("levels"), F.min(x).alias("least"), F.max(x).alias("most"), F.stddev_samp(x).alias("spread"))
    boxes = percentiles(own, group, x, [0.25, 0.5, 0.75])
    if not group:
        return sums.join(F.broadcast(boxes), how="left")  # one row each
    named = boxes.withColumnsRenamed({g: f"__{g}" for g in group})
    return sums.join(named, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], "left").drop(*[f"__{g}" for g in group])


def best(df: DataFrame, comparable: Sequence[str], loss: str, run: str, finished: Column) -> DataFrame:
    """Of the finished runs that can be compared the one of the least loss, then the least name;
    a run without a loss is none."""
    own = df.where(finished & F.col(loss).isNotNull())
    return own.groupBy(*comparable).agg(F.min_by(run, F.struct(loss, run)).alias("best_run"))


def best_match(lanes: DataFrame, others: DataFrame, image: str, key: str, xs: str, tolerance: float) -> DataFrame:
    """``(key, best)``: for each lane the greatest share of its points that a lane of ``others`` in
    its image has within ``tolerance``; 0 without another lane. Images have few lanes: pairs
    grow with the lanes, not with their square."""
    g = lanes.select(F.col(key), F.col(image).alias("image"), F.col(xs).alias("g"))
    p = others.select(F.col(image).alias("image"), F.col(xs).alias("p"))
    near = F.size(F.filter(F.zip_with("g", "p", lambda x, y: F.abs(x - y)), lambda d: d < F.lit(tolerance)))
    return g.join(p, "image", "left").groupBy(key).agg(F.coalesce(F.max(F.try_divide(near.cast("double"), F.size("g"))), F.lit(0.0)).alias("best"))


def seeded(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, those of the least seeded hashes of ``key`` (then the least key): the same on
    every run. Each task keeps ``n`` at most."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def closed(df: DataFrame, group: Sequence[str], order: Sequence[str], state: str, width: int = 3) -> DataFrame:
    """``df`` with ``wide`` and ``closed``: the greatest of ``width`` neighbouring states, and the least
    of those; gaps of under ``width`` places are filled. An even width reaches one place
    further back than ahead in the first step, and ahead in the second; beyond the ends nothing
    counts."""
    back, ahead = width // 2, (width - 1) // 2
    w = Window.partitionBy(*group).orderBy(*order)
    wide = df.withColumn("wide", F.max(state).over(w.rowsBetween(-back, ahead)))
    return wide.withColumn("closed", F.min("wide").over(w.rowsBetween(-ahead, back)))
