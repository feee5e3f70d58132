"""Localisation of markings by nearest points, and the choice of its tolerance.

Point sets are ``array<struct<x, y>>`` of one image each, so distances are nested loops over
arrays inside a row, no join and no Python. Distances are shares of the image's diagonal.

Defined results: without points on the other side each distance is infinite; recall is null
without reference points, precision without predicted ones; errors are null unless all are
finite; nulls take no part in means.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E

#: Names and bounds of the bands, as shares of the height; the rows below the
#: last one, where the vehicle itself is seen, are in none.
BANDS = {"upper": (0.0, 0.40), "middle": (0.40, 0.80), "lower": (0.80, 0.95)}
INFINITE = float("inf")


def diagonal(width: Column, height: Column) -> Column:
    return F.hypot(width.cast("double"), height.cast("double"))


def canonical(points: Column, width: Column, height: Column) -> Column:
    """Points as shares of the diagonal."""
    d = diagonal(width, height)
    return F.transform(points, lambda p: F.struct(F.try_divide(p["x"], d).alias("x"), F.try_divide(p["y"], d).alias("y")))


def nearest(points: Column, others: Column) -> Column:
    """For each of ``points`` the distance to the nearest of ``others``; infinite without."""

    def one(p: Column) -> Column:
        return F.coalesce(F.array_min(F.transform(others, lambda o: F.hypot(p["x"] - o["x"], p["y"] - o["y"]))), F.lit(INFINITE))

    return F.transform(points, one)


def _percentile(sorted_: Column, q: float) -> Column:
    """Of a sorted array, between its values."""
    at = (F.size(sorted_) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_, low), F.get(sorted_, F.least(low + 1, F.size(sorted_) - 1))
    return F.when(F.size(sorted_) > 0, a + (b - a) * (at - low))


def _share(distances: Column, delta: Column) -> Column:
    return F.try_divide(F.size(F.filter(distances, lambda d: d <= delta)).cast("double"), F.size(distances).cast("double"))


def harmonic(p: Column, r: Column) -> Column:
    """0 where both are 0, null where one is."""
    return F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))


def support(df: DataFrame, forward: str, backward: str, delta: Column, prefix: str = "") -> DataFrame:
    """``df`` with precision, recall, F1 and, of the reference's distances ``forward``, median
    and 95th percentile. ``backward`` are the prediction's distances."""
    f, b = F.col(forward), F.col(backward)
    ok = (F.size(f) > 0) & ~F.exists(f, lambda d: d == INFINITE)
    ordered = F.when(ok, F.array_sort(f))
    out = df.withColumns({f"{prefix}precision": _share(b, delta), f"{prefix}recall": _share(f, delta)})
    return out.withColumns({f"{prefix}f1": harmonic(F.col(f"{prefix}precision"), F.col(f"{prefix}recall")), f"{prefix}err_median": _percentile(ordered, 0.5), f"{prefix}err_p95": _percentile(ordered, 0.95)})


def localise(df: DataFrame, pred: str, gt: str, width: str, height: str, delta: float) -> DataFrame:
    """``df`` with the ``D3p_`` columns, the unsupported share ``D6p_`` and, for each band of
    rows, ``D4p_<band>_f1`` and ``_recall``. Points are in pixels."""
    if not (delta >= 0 and delta < INFINITE):
        raise ValueError(f"a tolerance must be finite and not negative: {delta!r}")
    w, h, kept = F.col(width), F.col(height), df.columns
    none = F.array().cast(df.schema[gt].dataType)

    def distances(own: DataFrame, name: str, p: Column, g: Column) -> DataFrame:
        own = own.withColumns({"__p": canonical(F.coalesce(p, none), w, h), "__g": canonical(F.coalesce(g, none), w, h)})
        own = own.withColumns({f"__{name}_f": nearest(F.col("__g"), F.col("__p")), f"__{name}_b": nearest(F.col("__p"), F.col("__g"))})
        return support(own, f"__{name}_f", f"__{name}_b", F.lit(delta), f"__{name}_")

    out = distances(df, "all", F.col(pred), F.col(gt))
    inside = lambda c, band: F.filter(c, lambda p: (p["y"] >= band[0] * h) & (p["y"] < band[1] * h))
    for name, band in BANDS.items():
        out = distances(out, name, inside(F.col(pred), band), inside(F.col(gt), band))
    every = [F.col(f"__all_{a}").alias(f"D3p_{b}") for a, b in (("f1", "support_f1"), ("precision", "support_precision"), ("recall", "support_recall"), ("err_median", "loc_err_median"), ("err_p95", "loc_err_p95"))]
    counts = [F.size("__all_b").alias("D3p_n_pred_points"), F.size("__all_f").alias("D3p_n_gt_points"), F.lit(float(delta)).alias("D3p_delta"), (1 - F.col("__all_recall")).alias("D6p_unsupported_marking_ratio")]
    bands = [F.col(f"__{n}_{x}").alias(f"D4p_{n}_{x}") for n in BANDS for x in ("f1", "recall")]
    return out.select(*kept, *every, *counts, *bands)


def summarise(df: DataFrame, group: Sequence[str] = (), eligible: Column | None = None) -> DataFrame:
    """Means of what ``localise`` gives over eligible rows, and the tolerances that occur."""
    own = df if eligible is None else df.where(eligible)
    means = ["D3p_support_f1", "D3p_support_precision", "D3p_support_recall", "D3p_loc_err_median", "D3p_loc_err_p95", "D6p_unsupported_marking_ratio", *[f"D4p_{n}_f1" for n in BANDS]]
    return own.groupBy(*group).agg(F.count("*").alias("D3p_num_scored"), F.array_sort(F.collect_set("D3p_delta")).alias("D3p_deltas"), *[E.mean(F.col(m)).alias(f"{m}_mean") for m in means])


def knee(curve: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group the ``x`` whose ``y`` is furthest above the chord of the curve, scaled to 0 to
    1 on both axes; the first on ties; null under three points or without extent."""
    own = curve.select(*group, E.finite(F.col(x)).alias("__x"), E.finite(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    over = Window.partitionBy(*group)
    ends = {"x0": F.min("__x"), "x1": F.max("__x"), "y0": F.min("__y"), "y1": F.max("__y"), "first": F.min_by("__y", "__x"), "last": F.max_by("__y", "__x"), "points": F.count("*")}
    own = own.withColumns({f"__{k}": f.over(over) for k, f in ends.items()})  # a curve has few points
    scale = lambda c: F.try_divide(c - F.col("__y0"), F.col("__y1") - F.col("__y0"))
    u = F.try_divide(F.col("__x") - F.col("__x0"), F.col("__x1") - F.col("__x0"))
    above = F.round(scale(F.col("__y")) - (scale(F.col("__first")) + u * (scale(F.col("__last")) - scale(F.col("__first")))), 9)
    own = own.withColumn("__above", F.when(F.col("__points") >= 3, above))
    return own.groupBy(*group).agg(F.max_by("__x", F.when(F.col("__above").isNotNull(), F.struct("__above", -F.col("__x")))).alias("knee"))


def operating_point(curve: DataFrame, group: Sequence[str], threshold: str, score: str) -> DataFrame:
    """Per group the threshold of the best score, the first on ties; null scores are out."""
    own = curve.select(*group, F.col(threshold).alias("__t"), E.finite(F.col(score)).alias("__s")).where("__s is not null")
    best = F.max_by(F.struct(F.col("__t").alias("threshold"), F.col("__s").alias("score")), F.struct(F.round("__s", 9), -F.col("__t")))
    return own.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def select_delta(df: DataFrame, key: Sequence[str], forward: str, backward: str, grid: Sequence[float], percentile: float = 0.9) -> DataFrame:
    """One row: the knee of the mean F1 over ``grid``, the percentile of the pooled finite
    distances, and the chosen tolerance with its rule."""
    from .order import percentiles
    from .relational import support_curve

    curve = support_curve(df, key, forward, backward, grid)
    bend = knee(curve, [], "delta", "mean_f1")
    pooled = df.select(F.explode(forward).alias("d")).where(E.finite(F.col("d")).isNotNull())
    share = percentiles(pooled, [], F.col("d"), [percentile]).select(F.col("q0").alias("delta_percentile"))  # one row
    both = bend.crossJoin(F.broadcast(share))
    rule = F.when(F.col("knee").isNotNull(), "f1_knee").when(F.col("delta_percentile").isNotNull(), "gt_error_percentile").otherwise("undefined_insufficient_data")
    return both.select(F.col("knee").alias("delta_knee"), "delta_percentile", F.coalesce("knee", "delta_percentile").alias("delta_selected"), rule.alias("selection_rule"))


def bootstrap_knee(df: DataFrame, forward: str, backward: str, grid: Sequence[float], draws: int = 200, seed: int = 20260810) -> DataFrame:
    """One row: the spread of the knee when images are drawn anew, and whether its quartiles
    are at most one step of the grid apart. Each image is drawn Poisson(1) times in each of
    ``draws``, by a seed of its own, so that no task needs all images; only sums over images,
    a row per draw, meet."""
    steps = sorted(float(d) for d in grid)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, len(steps), 2))
        for rows in batches:
            for key, f, b in zip(rows["k"], rows["f"], rows["b"], strict=True):
                if f is None or b is None or not len(f) or not len(b):
                    continue
                r, p = ((np.asarray(x, float)[:, None] <= np.array(steps)).mean(axis=0) for x in (f, b))
                score = np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=p + r > 0)
                times = np.random.default_rng([seed, int(key) & 0x7FFFFFFF, int(key) >> 31 & 0xFFFFFFFF]).poisson(1, draws)
                total[:, :, 0] += times[:, None] * score
                total[:, :, 1] += times[:, None]
        yield pd.DataFrame({"draw": np.repeat(np.arange(draws), len(steps)), "delta": np.tile(steps, draws), "s": total[:, :, 0].ravel(), "n": total[:, :, 1].ravel()})

    own = df.select(F.xxhash64(forward, backward).alias("k"), F.col(forward).cast("array<double>").alias("f"), F.col(backward).cast("array<double>").alias("b"))
    curve = own.mapInPandas(sums, "draw int, delta double, s double, n double").groupBy("draw", "delta").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("f1"))
    found = knee(curve, ["draw"], "delta", "f1").where("knee is not null")
    step = float(np.median(np.diff(steps))) if len(steps) > 1 else 0.0
    spread = found.agg(F.count("*").alias("n_boot"), F.percentile("knee", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("knee").alias("least"), F.max("knee").alias("most"))
    return spread.select("n_boot", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "least", "most", (F.col("q")[2] - F.col("q")[0] <= step + 1e-12).alias("stable_within_one_grid_step"))


def pooled(frames: Sequence[DataFrame], key: Sequence[str], forward: str, backward: str) -> DataFrame:
    """Distances of several models, one below another."""
    return functools.reduce(DataFrame.unionByName, [f.select(*key, forward, backward) for f in frames])
