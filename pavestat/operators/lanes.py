"""From lanes to images: weighted aggregates of a row per lane, and weighted quantiles.

A lane weighs confidence times the root of its support, which is bounded by a multiple of the
image's median support. So weights need two passes: medians per image, then sums. Lanes
without a score count as unknown and weigh nothing. Images are as many as lanes, so their
lanes meet in one shuffle and both passes are windows over it; only images of very many lanes
go by sketches.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from .order import large_groups, middle_parts, percentiles, same_keys, split, written

#: Lanes of an image that one task orders.
HELD = 1 << 16
#: The least support and sum of weights, the bound as a multiple of the median,
#: the share of the median in a stability, and of the shortest lane's support in its bound.
TINY, RATIO, MEDIAN_SHARE, SHORTEST = 1e-9, 2.0, 0.65, 4.0
#: Floors of the confidences.
LEAST_CONFIDENCE, LEAST_VALID, LEAST_PAIR = 0.15, 0.10, 0.10
#: What an image's condition or profile is when its lanes differ, the first that occurs.
CONDITIONS, CONDITION_ELSE = ("partially_missing", "fragmented", "faded"), "intact"
PROFILES, PROFILE_ELSE = ("irregular_or_noisy", "merge_or_split_transition"), "piecewise_transition"


def _weighted(df: DataFrame, group: Sequence[str], score: str, support: str, factors: Mapping[str, float], shortest: float | None, small: bool) -> DataFrame:
    """All lanes with ``__s`` (the score) and ``__w`` (the weight), both null without a score: the
    product of ``factors`` (columns and their floors; null is 0) and the root of the bounded
    support. Where an image's weights sum to nothing all its lanes weigh 1. Of ``small`` images a
    task takes all lanes in windows, of others medians come from sketches."""
    whole = Window.partitionBy(*group)
    scored = F.col("__s").isNotNull()
    own = df.withColumn("__s", finite(F.col(score))).withColumn("__u", F.when(scored, F.greatest(F.coalesce(finite(F.col(support)), F.lit(0.0)), F.lit(TINY))))
    if small:
        own = middle_parts(own, group, "__u", "__part")
        own = own.withColumns({"__middle": F.sum("__part").over(whole), "__least": F.min("__u").over(whole)})
    else:
        least = own.groupBy(*group).agg(F.min("__u").alias("__least"))
        own = _joined(own, [percentiles(own, group, F.col("__u"), [0.5]).withColumnRenamed("q0", "__middle"), least], group)
    bound = RATIO * F.col("__middle")
    if shortest is not None:
        bound = F.least(bound, shortest * F.col("__least"))
    weight = F.sqrt(F.least(F.col("__u"), F.greatest(bound, F.lit(TINY))))
    for c, least in factors.items():
        weight = weight * F.greatest(F.coalesce(finite(F.col(c)), F.lit(0.0)), F.lit(least))
    own = own.withColumn("__w", F.when(scored, weight))
    if math.prod(factors.values()) * math.sqrt(TINY) <= TINY:  # else no weight is as small
        total = F.sum("__w").over(whole) if small else F.col("__all")
        own = own if small else _joined(own, [own.groupBy(*group).agg(F.sum("__w").alias("__all"))], group)
        own = own.withColumn("__w", F.when(scored, F.when(total > TINY, F.col("__w")).otherwise(1.0)))
    return own.select(*df.columns, "__s", "__w")


def _mean(c: Column) -> Column:
    return F.try_divide(F.sum(F.col("__w") * c), F.sum("__w"))


def _joined(base: DataFrame, found: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """All of ``base``, with nulls where an image has no lane with a score."""
    for df in found:
        named = df.withColumnsRenamed({g: f"__{g}" for g in group})
        on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
        base = base.join(named, on, "left").drop(*[f"__{g}" for g in group])
    return base


def _one_of(c: str, order: Sequence[str], otherwise: str) -> Column:
    """The value that all lanes with a score have, or the first of ``order`` that one has."""
    own = F.when(F.col("__s").isNotNull(), F.col(c))
    same = F.min(own) == F.max(own)
    first = F.coalesce(*[F.max(F.when(own == v, v)) for v in order], F.lit(otherwise))
    return F.when(F.count("__s") > 0, F.when(same, F.min(own)).otherwise(first))


def _images(df: DataFrame, group: Sequence[str], score: str, support: str, factors: Mapping[str, float], aggregates: Sequence[Column], halves: Mapping[str, str] | None = None, shortest: float | None = None) -> DataFrame:
    """Per image ``aggregates`` of its weighted lanes, their ``median`` score, and for each name of
    ``halves`` the weighted median of a column. Images of at most ``HELD`` lanes are shuffled
    once and taken whole; the others, few of many lanes, go by sketches and parts."""
    halves = halves or {}

    def whole(df: DataFrame) -> DataFrame:
        own = middle_parts(_weighted(df, group, score, support, factors, shortest, True), group, "__s", "__part")
        for name, c in halves.items():
            own = _reached(own, group, c, f"__{name}")
        found = [F.coalesce(F.min(F.col(f"__{name}.reached")), F.max(F.col(f"__{name}.v"))).alias(name) for name in halves]
        return own.groupBy(*group).agg(*aggregates, F.sum("__part").alias("median"), *found)

    def cut(df: DataFrame) -> DataFrame:
        own = written(_weighted(df, group, score, support, factors, shortest, False), "lanes")
        found = [weighted_quantile(own, group, c, "__w", 0.5).withColumnRenamed("quantile", name) for name, c in halves.items()]
        return _joined(own.groupBy(*group).agg(*aggregates), [percentiles(own, group, F.col("__s"), [0.5]).withColumnRenamed("q0", "median"), *found], group)

    large = large_groups(df, group, HELD)
    if large.isEmpty():
        return whole(df)
    named = F.broadcast(large.withColumnsRenamed({g: f"__{g}" for g in group}))
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    out = whole(df.join(named, on, "left_anti"))
    return out.unionByName(cut(df.join(named, on, "left_semi")).select(*out.columns))


def complexity(df: DataFrame, group: Sequence[str], score: str = "complexity_score", confidence: str = "complexity_confidence", support: str = "valid_support_length") -> DataFrame:
    """Per image ``alignment_complexity, complexity_confidence, median, max, valid_count,
    unknown_count, unavailable_reason`` of its lanes' complexities."""
    aggregates = [
        _mean(F.col("__s")).alias("alignment_complexity"), _mean(F.coalesce(finite(F.col(confidence)), F.lit(0.0))).alias("complexity_confidence"),
        F.max("__s").alias("max"), F.count("__s").alias("valid_count"), F.count_if(F.col("__s").isNull()).alias("unknown_count"),
    ]
    out = _images(df, group, score, support, {confidence: LEAST_CONFIDENCE}, aggregates)
    none = F.col("valid_count") == 0
    return out.select(*group, "alignment_complexity", F.coalesce("complexity_confidence", F.lit(0.0)).alias("complexity_confidence"), "median", "max", "valid_count", "unknown_count", F.when(none, "no_valid_lane_geometry_complexity").alias("unavailable_reason"))


def continuity(df: DataFrame, group: Sequence[str], score: str = "continuity_score", confidence: str = "pattern_confidence", valid: str = "valid_sample_fraction", support: str = "usable_support", pattern: str = "intended_pattern", condition: str = "condition") -> DataFrame:
    """Per image ``continuity, worst, median, pattern, pattern_confidence, condition, valid_count,
    unknown_count`` of its lanes' continuities. A long lane weighs no more than the shortest
    lane's support allows; lanes of an unknown pattern are unknown as well."""
    unknown = F.col("__s").isNull() | F.coalesce(F.col(pattern) == "unknown", F.lit(False))
    aggregates = [
        _mean(F.col("__s")).alias("continuity"), F.min("__s").alias("worst"), _one_of(pattern, (), "mixed").alias("pattern"),
        _mean(F.coalesce(finite(F.col(confidence)), F.lit(0.0))).alias("pattern_confidence"), _one_of(condition, CONDITIONS, CONDITION_ELSE).alias("condition"),
        F.count("__s").alias("valid_count"), F.count_if(unknown).alias("unknown_count"),
    ]
    out = _images(df, group, score, support, {confidence: LEAST_CONFIDENCE, valid: LEAST_VALID}, aggregates, shortest=SHORTEST)
    return out.select(*group, "continuity", "worst", "median", F.coalesce("pattern", F.lit("unknown")).alias("pattern"), "pattern_confidence", F.coalesce("condition", F.lit("unknown_condition")).alias("condition"), "valid_count", "unknown_count")


def width_stability(df: DataFrame, group: Sequence[str], score: str = "stability_score", constancy: str = "width_constancy_score", geometry: str = "geometry_confidence", profile: str = "profile_confidence", support: str = "support_length", kind: str = "profile_type") -> DataFrame:
    """Per image ``stability, constancy, profile_type, profile_confidence, geometry_confidence,
    worst, median, valid_count, unknown_count`` of its pairs of lanes. Stability leans on
    the weighted median, constancy is one."""
    aggregates = [
        _mean(F.col("__s")).alias("__mean"), _one_of(kind, PROFILES, PROFILE_ELSE).alias("profile_type"), _mean(finite(F.col(profile))).alias("profile_confidence"),
        _mean(finite(F.col(geometry))).alias("geometry_confidence"), F.min("__s").alias("worst"), F.count("__s").alias("valid_count"), F.count_if(F.col("__s").isNull()).alias("unknown_count"),
    ]
    out = _images(df, group, score, support, {geometry: LEAST_PAIR, profile: LEAST_PAIR}, aggregates, {"__half": "__s", "constancy": constancy})
    stability = MEDIAN_SHARE * F.col("__half") + (1 - MEDIAN_SHARE) * F.col("__mean")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*group, stability.alias("stability"), "constancy", F.coalesce("profile_type", F.lit("unknown")).alias("profile_type"), zero("profile_confidence"), zero("geometry_confidence"), "worst", "median", "valid_count", "unknown_count")


def _reached(own: DataFrame, group: Sequence[str], value: str, as_: str) -> DataFrame:
    """``own`` with ``as_``: a lane's value ``v`` if it has one and a weight, and the same as
    ``reached`` if half of the image's weight is reached there. A task orders an image."""
    own = own.withColumn("__v", F.when(F.col("__w") > 0, finite(F.col(value))))
    mass = F.when(F.col("__v").isNotNull(), F.col("__w"))
    order = Window.partitionBy(*group).orderBy(F.col("__v").asc_nulls_last(), "__w")
    run = F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = own.withColumns({"__run": run, "__all": all_})
    reached = F.when(F.col("__run") >= F.col("__all") * 0.5, F.col("__v"))
    return own.withColumn(as_, F.struct(F.col("__v").alias("v"), reached.alias("reached"))).drop("__v", "__run", "__all")


def _running(df: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """``(group, v, w, n, before, all)``: the different pairs of value and weight in their order,
    how often each stands there, and the weight before it and of the group. Weights of 0 or
    less, and what is not finite, are out. Running sums go inside parts of a group's values."""
    own = df.select(*group, finite(F.col(value)).alias("v"), finite(F.col(weight)).alias("w")).where("v is not null and w > 0")
    by = own.groupBy(*group, "v", "w").agg(F.count("*").alias("n"))
    parts = split(by, group, "v")
    mass = F.col("w") * F.col("n")
    under = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*group, "__part").agg(F.sum(mass).alias("s"))
    starts = sums.select(*group, "__part", F.coalesce(F.sum("s").over(under), F.lit(0.0)).alias("start"), F.sum("s").over(Window.partitionBy(*group)).alias("all"))
    inside = Window.partitionBy(*group, "__part").orderBy("v", "w").rowsBetween(Window.unboundedPreceding, -1)
    return same_keys(parts, starts, [*group, "__part"]).select(*group, "v", "w", "n", (F.col("start") + F.coalesce(F.sum(mass).over(inside), F.lit(0.0))).alias("before"), "all")


def weighted_quantile(df: DataFrame, group: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Per group the first value at which the running weight reaches ``q`` of all weight."""
    own = _running(df, group, value, weight)
    reached = F.col("before") + F.col("w") * F.col("n") >= F.col("all") * min(max(q, 0.0), 1.0)
    return own.groupBy(*group).agg(F.coalesce(F.min(F.when(reached, F.col("v"))), F.max("v")).alias("quantile"))


def midpoint_quantile(df: DataFrame, group: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Per group the value at ``q`` of all weight, where each value stands at the middle of its
    weight and values between are interpolated; outside, the first or last. Equal pairs of
    value and weight are told by their number: the k-th of them stands at ``before + (k + 1/2) w``."""
    own = _running(df, group, value, weight)
    target = F.col("all") * min(max(q, 0.0), 1.0)
    k = F.floor((target - F.col("before")) / F.col("w") - 0.5)  # the last of the pair at or below
    stand = lambda j: F.struct((F.col("before") + (j + 0.5) * F.col("w")).alias("at"), F.col("v").alias("v"))
    below = F.when(k >= 0, stand(F.least(k, F.col("n") - 1)))
    above = F.when(k < F.col("n") - 1, stand(F.greatest(k + 1, F.lit(0))))
    found = own.groupBy(*group).agg(F.max(below).alias("l"), F.min(above).alias("h"), F.first("all").alias("all"))
    share = F.try_divide(target - F.col("l.at"), F.col("h.at") - F.col("l.at"))
    between = F.col("l.v") + share * (F.col("h.v") - F.col("l.v"))
    return found.select(*group, F.coalesce(between, F.col("l.v"), F.col("h.v")).alias("quantile"))
