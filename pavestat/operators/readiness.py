"""Readiness scores of metric records: composites, conditions, associations, summary.

A metric record is a row; its measures are columns that may be missing altogether, null,
NaN or text. A value that cannot be computed is null, with a reason where one is given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from .order import numbered, percentiles, ranked_pairs, same_keys

#: Weights of the scores and the names that a measure had before.
R1_TERMS = [("I1_pattern_continuity", "I1", 0.35), ("I2_local_contrast", "I2", 0.35), ("I3_boundary_sharpness", "I3", 0.20)]
R2_TERMS = [("D3_f1", None, 0.35), ("D3_iou", "D3", 0.20), ("D4_near_iou", "D4", 0.20)]
R1_LEGACY, R2_MISSED, R2_CONFIDENCE = 0.10, 0.20, 0.05
HIGH, MODERATE = 80.0, 60.0
#: Conditions that serve as baseline, and the keys that tell a condition, the
#: preferred ones first.
BASELINES = ("clear", "daytime", "day", "normal", "low")
CONDITIONS = ("condition", "weather", "timeofday", "scene")
#: The measures whose means a summary has.
MEASURES = """I1 I1_pattern_continuity I1_worn_fraction I1_faded_fraction
I2 I2_local_contrast I3 I3_boundary_sharpness
I4 I4_lane_width_stability I4_pair_count
I4_legacy_thickness_stability I4_legacy_mean_thickness_px I4_legacy_thickness_cv I4_legacy_num_segments
I5 I5_geometry_complexity I5_alignment_complexity I5_topology_complexity
I5_complexity_confidence I5_bendiness I5_mean_abs_curvature I5_p95_abs_curvature
I5_curvature_variation I5_p95_curvature_gradient I5_reversal_count I5_reversal_density
I5_total_abs_heading_change I5_tortuosity I5_primitive_count
I5_valid_lane_count I5_unknown_lane_count I5_legacy_quadratic_proxy
I5_pred I5_pred_geometry_complexity I5_pred_alignment_complexity I5_pred_topology_complexity
I5_pred_complexity_confidence
I6 I6_marking_instance_count I6_raw_component_count I6_topology_complexity
D1 D1_detection D2 D2_count_match D3 D3_iou D3_f1 D3_precision D3_recall
D4 D4_near_iou D6 D6_image_missed_ratio D7 D7_confidence_mean
R1 R1_marking_readability_score R2 R2_reference_detectability_score""".split()
#: Association of less spread than this is none.
SPREAD = 1e-8


def _own(columns: Sequence[str], *names: str | None) -> Column:
    """The first of ``names`` that is a column; null if none is."""
    return next((F.col(n) for n in names if n in columns), F.lit(None).cast("double"))


def r1(columns: Sequence[str]) -> Column:
    """Readability, 0 to 100. The paint's thickness counts under its legacy name, or as plain
    I4 in records that have no lane width yet."""
    older = "I4" if "I4_lane_width_stability" not in columns else None
    terms = [(_own(columns, a, b), w) for a, b, w in R1_TERMS]
    terms.append((_own(columns, "I4_legacy_thickness_stability", "I4_thickness_stability", older), R1_LEGACY))
    return 100 * E.weighted_mean(terms)


def r2(columns: Sequence[str]) -> Column:
    """Detectability, 0 to 100; of pixels missed, the share that was not."""
    terms = [(_own(columns, a, b), w) for a, b, w in R2_TERMS]
    missed = E.finite(_own(columns, "D6_image_missed_ratio", "D6"))
    terms += [(E.clip(1 - missed, 0.0, 1.0), R2_MISSED), (_own(columns, "D7_confidence_mean", "D7"), R2_CONFIDENCE)]
    return 100 * E.weighted_mean(terms)


def r4(one: Column, two: Column) -> Column:
    """Class and reason of the two scores."""
    high = F.coalesce((one >= HIGH) & (two >= HIGH), F.lit(False))
    some = F.coalesce(one >= MODERATE, F.lit(False)) | F.coalesce(two >= MODERATE, F.lit(False))
    none = one.isNull() & two.isNull()
    status = F.when(high, "HIGH_MACHINE_READABILITY").when(some, "MODERATE_MACHINE_READABILITY").otherwise("LOW_MACHINE_READABILITY")
    reason = F.when(none, "no score could be computed").when(high, "both scores are high").when(some, "at least one score is moderate or better").otherwise("no score is moderate")
    return F.struct(status.alias("status"), reason.alias("reason"))


def scored(df: DataFrame) -> DataFrame:
    """Records with both scores and the class."""
    df = df.withColumn("R1_marking_readability_score", r1(df.columns)).withColumn("R2_reference_detectability_score", r2(df.columns))
    return df.withColumn("R4_machine_readability_class", r4(F.col("R1_marking_readability_score"), F.col("R2_reference_detectability_score")))


def condition_key(df: DataFrame, keys: Sequence[str] = CONDITIONS) -> str | None:
    """The first of ``keys`` that has two values or more."""
    there = [k for k in keys if k in df.columns]
    if not there:
        return None
    # min and max tell two values from one, without a set of all
    row = df.agg(*[(F.min(F.col(k).cast("string")) < F.max(F.col(k).cast("string"))).alias(k) for k in there]).first()
    return next((k for k in there if row[k]), None)


def degradation(df: DataFrame, condition: str, least: int = 10, baseline: str | None = None, scores: Sequence[str] = ("R1_marking_readability_score", "R2_reference_detectability_score")) -> DataFrame:
    """Per condition the drops of both scores, in shares, against the baseline, and their sum:
    the given or first usual condition that is there, else the largest (ties by name). Groups
    under ``least`` rows are out; a missing score is no drop; under two groups there are none."""
    names = ("readability", "detection")
    means = df.where(F.col(condition).isNotNull()).groupBy(F.col(condition).cast("string").alias("condition"))
    means = means.agg(F.count("*").alias("n"), *[(E.mean(F.col(s)) / 100).alias(m) for s, m in zip(scores, names, strict=True)]).where(F.col("n") >= least)
    prefer = BASELINES if baseline is None else (baseline,)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, prefer)), F.col("condition")), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(prefer) + 1)
    base = means.agg(F.count("*").alias("groups"), F.min_by(F.struct(F.col("condition").alias("baseline"), *[F.col(m).alias(f"base_{m}") for m in names]), F.struct(rank, -F.col("n"), "condition")).alias("b")).select("groups", "b.*")  # one row
    out = means.crossJoin(F.broadcast(base)).where("groups >= 2")
    drops = [F.coalesce(F.col(f"base_{m}") - F.col(m), F.lit(0.0)) for m in names]
    return out.select(F.lit(condition).alias("condition_key"), "condition", "baseline", "n", drops[0].alias("readability_drop"), drops[1].alias("detection_drop"), (drops[0] + drops[1]).alias("degradation"))


def _tail(r: float, n: int) -> float | None:
    """Two-sided probability of a correlation of ``n`` pairs under none: the incomplete beta
    function of (n - 2) / 2 and 1 / 2 at 1 - r * r, by its continued fraction."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    x, a, b = max(0.0, 1 - r * r), (n - 2) / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value *= front / a
    return min(1.0, max(0.0, 1 - value if flip else value))


@F.pandas_udf(T.DoubleType())
def correlation_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of a row per group, not of records."""
    for r, n in batches:
        yield pd.Series([_tail(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")


def association(df: DataFrame, x: Column, y: Column, group: Sequence[str] = (), least: int = 10, p_values: bool = False) -> DataFrame:
    """Per group ``n, pearson, spearman, reason`` of the pairs where both are finite, and with
    ``p_values`` their probabilities. Under ``least`` pairs, or without spread, both are null."""
    pairs = df.select(*group, E.finite(x).alias("__x"), E.finite(y).alias("__y")).where("__x is not null and __y is not null")
    flat = (F.stddev_pop("__x") <= SPREAD) | (F.stddev_pop("__y") <= SPREAD)
    raw = pairs.groupBy(*group).agg(F.count("*").alias("n"), E.pearson(F.col("__x"), F.col("__y")).alias("p"), flat.alias("flat"))
    ranked = ranked_pairs(pairs, group, "__x", "__y").groupBy(*group).agg(E.weighted_pearson(F.col("__rx"), F.col("__ry"), F.col("__n")).alias("s"))
    found = same_keys(raw, ranked, group)
    reason = F.when(F.col("n") < least, f"insufficient_samples_n_lt_{least}").when(F.col("flat"), "zero_variance")
    told = found.select(*group, "n", F.when(reason.isNull(), F.col("p")).alias("pearson"), F.when(reason.isNull(), F.col("s")).alias("spearman"), reason.alias("reason"))
    if p_values:
        told = told.withColumns({f"{c}_p": correlation_p(F.col(c), F.col("n")) for c in ("pearson", "spearman")})
    return told


#: What is associated with what, by name.
LINKS = {
    "C1": ("I1_pattern_continuity", "D3_f1"), "C1_detected": ("I1_pattern_continuity", "1 - D6_image_missed_ratio"),
    "C2": ("I2_local_contrast", "D3_iou"), "C2_f1": ("I2_local_contrast", "D3_f1"),
    "C3": ("I3_boundary_sharpness", "D3_f1"), "C3_iou": ("I3_boundary_sharpness", "D3_iou"),
    "C4": ("I5_alignment_complexity", "D3_f1"), "C4_iou": ("I5_alignment_complexity", "D3_iou"), "C4_detected": ("I5_alignment_complexity", "1 - D6_image_missed_ratio"),
    "C4_bendiness": ("I5_bendiness", "D3_f1"), "C4_p95_curvature": ("I5_p95_abs_curvature", "D3_f1"), "C4_curvature_variation": ("I5_curvature_variation", "D3_f1"),
    "C4_reversal_density": ("I5_reversal_density", "D3_f1"), "C4_topology": ("I5_topology_complexity", "D3_f1"),
}


def associations(df: DataFrame, least: int = 10, links: Mapping[str, tuple[str, str]] = LINKS) -> DataFrame:
    """A row per name of ``links`` whose columns are there: ``name, n, pearson, spearman, reason``.
    All are told in one pass: pairs stand one below another, grouped by name."""
    there = {n: (x, y) for n, (x, y) in links.items() if x in df.columns and y.split()[-1] in df.columns}
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), E.finite(F.col(x)).alias("x"), E.finite(F.expr(y)).alias("y")) for n, (x, y) in there.items()]))
    return association(df.select(cells), F.col("x"), F.col("y"), ["name"], least)


def bottleneck(strengths: Sequence[tuple[str, Column, str]]) -> Column:
    """The candidate of the greatest absolute strength, the first on ties: ``name, strength,
    evidence``; ``unavailable`` without any. Nulls are no candidates."""
    cells = F.array(*[F.struct(F.abs(E.finite(c)).alias("strength"), F.lit(-k).alias("place"), F.lit(n).alias("name"), F.lit(e).alias("evidence")) for k, (n, c, e) in enumerate(strengths)])
    best = F.array_max(F.filter(cells, lambda z: z["strength"].isNotNull()))
    some = best.isNotNull()
    return F.struct(
        F.when(some, best["name"]).otherwise("unavailable").alias("name"), best["strength"].alias("strength"),
        F.when(some, best["evidence"]).otherwise("no computable correlation or descriptive metric").alias("evidence"),
    )


def _shortfall(*columns: Column) -> Column:
    """One less the first that is there and not 0; 0 if none is."""
    return 1 - F.coalesce(*[F.when(c != 0, c) for c in columns], F.lit(1.0))


def summary(df: DataFrame, least: int = 10, group: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Per group, or of all records, one row: number of records and of images with markings,
    whether there are confidences, the means of ``MEASURES`` that are there, ``D6`` pooled
    over eligible images, visibility gaps, both scores of the means and the class; of all
    records also the correlations of C1 to C3, the effect of C4, the worst condition of C5 and
    the bottleneck, and with ``ties`` (columns that tell records apart) ``C4_tertile``: the effect
    of the alignment's thirds with its interval, if the columns are there. Groups under ``least`` records are ``skipped``."""
    columns = df.columns
    measures = [m for m in MEASURES if m in columns]
    eligible = F.coalesce(_own(columns, "D_gt_eligible").cast("boolean"), F.lit(False))
    pooled = E.pooled(_own(columns, "D6_fn_pixels"), _own(columns, "D6_gt_pixels"), eligible)
    iou, seen = _own(columns, "D3_iou"), _own(columns, "D5_visibility_group").cast("string")
    means = df.groupBy(*group).agg(
        F.count("*").alias("num_records"),
        F.count_if(F.coalesce(_own(columns, "gt_nonzero"), F.lit(0)) > 0).alias("gt_nonzero_images"),
        F.count_if(F.coalesce(_own(columns, "pred_nonzero"), F.lit(0)) > 0).alias("pred_nonzero_images"),
        (F.count(_own(columns, "D7_confidence_mean")) > 0).alias("confidence_available"),
        *[E.mean(F.col(m)).alias(m) for m in measures if not m.startswith("D6")],
        *[pooled.alias(m) for m in ("D6", "D6_image_missed_ratio")],
        E.gap(iou, eligible & (seen == "clear"), eligible & (seen == "occluded")).alias("D5_occlusion_robustness_gap"),
        E.gap(iou, eligible & (seen == "clear"), eligible & seen.isin("occluded", "degraded")).alias("D5_visibility_degraded_gap"),
    )
    own = [c for c in means.columns if not c.startswith(("R1", "R2"))]
    means = means.withColumn("layer_r1", r1(own)).withColumn("layer_r2", r2(own)).withColumn("layer_r4", r4(F.col("layer_r1"), F.col("layer_r2")))
    if group:
        return means.withColumn("skipped", F.col("num_records") < least)
    told = associations(df, least, {c: LINKS[c] for c in ("C1", "C2", "C3")})
    c = told.agg(*[F.max(F.when(F.col("name") == n, F.col("spearman"))).alias(n) for n in ("C1", "C2", "C3")])  # one row
    out = means.crossJoin(F.broadcast(c))
    out = out.crossJoin(F.broadcast(_geometry_effect(df, least)))
    if ties and {ALIGNMENT, "D3_f1"} <= set(columns):
        effect = tertile_effects(df, [], ALIGNMENT, "D3_f1", ties, least)
        out = out.crossJoin(F.broadcast(effect.select(F.struct(*effect.columns).alias("C4_tertile"))))  # one row
    key = condition_key(df)
    scores = ["R1_marking_readability_score", "R2_reference_detectability_score"]
    if key and set(scores) <= set(columns):
        worst = degradation(df, key, least).agg(F.max_by(F.struct("condition", "degradation"), F.struct("degradation", "condition")).alias("C5"))  # one row
        out = out.crossJoin(F.broadcast(worst))
    else:
        out = out.withColumn("C5", F.lit(None).cast("struct<condition: string, degradation: double>"))
    names, here = "descriptive worst-score fallback", out.columns
    best = bottleneck([
        ("low pattern continuity", F.col("C1"), "C1 Spearman"), ("low local contrast", F.col("C2"), "C2 Spearman"), ("low boundary sharpness", F.col("C3"), "C3 Spearman"),
        ("geometry sensitivity", F.col("C4"), "C4 effect"), ("worst condition stratum", F.col("C5.degradation"), "C5 degradation"),
        ("low pattern continuity", _shortfall(_own(here, "I1_pattern_continuity"), _own(here, "I1")), names),
        ("low local contrast", _shortfall(_own(here, "I2_local_contrast"), _own(here, "I2")), names),
        ("low boundary sharpness", _shortfall(_own(here, "I3_boundary_sharpness"), _own(here, "I3")), names),
        ("high missed marking ratio", F.when(F.col("D6") != 0, F.col("D6")), names),
        ("occlusion/visibility robustness gap", F.col("D5_visibility_degraded_gap"), names),
    ])
    return out.withColumn("layer_r3", best)


#: The measures of geometry whose effects on detection a summary has, by median and by thirds.
GEOMETRY, ALIGNMENT = "I5_geometry_complexity", "I5_alignment_complexity"


def _geometry_effect(df: DataFrame, least: int, x: str = GEOMETRY, y: str = "D3_f1") -> DataFrame:
    """One row, ``C4``: the mean of ``y`` at or under the median of ``x`` less that above; null
    under ``least`` pairs, without spread or with an empty side."""
    if not {x, y} <= set(df.columns):
        return df.sparkSession.createDataFrame([(None,)], "C4 double")
    pairs = df.select(E.finite(F.col(x)).alias("x"), E.finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    middle = percentiles(pairs, [], F.col("x"), [0.5])  # one row
    low = F.col("x") <= F.col("q0")
    effect = F.avg(F.when(low, F.col("y"))) - F.avg(F.when(~low, F.col("y")))
    return pairs.crossJoin(F.broadcast(middle)).agg(F.when((F.count("*") >= least) & (F.stddev_pop("x") > SPREAD), effect).alias("C4"))


def wear_summary(rows: DataFrame, tag: str, score: str) -> DataFrame:
    """Per bucket of wear: scored rows, mean, median, least and greatest score, to four places."""
    own = rows.select(E.wear_bucket(F.col(tag)).alias("bucket"), E.finite(F.col(score)).alias("v")).where("v is not null")
    found = own.groupBy("bucket").agg(F.count("*").alias("n"), *[F.bround(f("v"), 4).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])
    middle = percentiles(own, ["bucket"], F.col("v"), [0.5]).select("bucket", F.bround("q0", 4).alias("median"))
    return same_keys(found, middle, ["bucket"]).select("bucket", "n", "mean", "median", "least", "most")


#: Draws of a bootstrap, and (group, side) sums that one task holds before it hands them on.
DRAWS, HELD = 1000, 256


def _drawn(df: DataFrame, group: Sequence[str], draws: int, seed: int) -> DataFrame:
    """``df(group, side, y, n)``, a row for each value of a side, to ``(group, side, draw, s, w)``:
    the sum and number of the values in each of ``draws``. A value that stands there n times is
    drawn Poisson(n) times, by a seed of its own: the draws do not depend on how rows lie, and
    sums of tasks add up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            keys, values = list(sums), np.concatenate(list(sums.values()), axis=1)
            at = np.repeat(np.arange(len(keys)), draws)
            out = pd.DataFrame({c: pd.Series([k[i] for k in keys], dtype=object).iloc[at].to_numpy() for i, c in enumerate([*group, "side"])})
            sums.clear()
            return out.assign(draw=np.tile(np.arange(draws), len(keys)), s=values[0], w=values[1])

        for rows in batches:
            for *key, y, n, h in rows.itertuples(index=False):
                times = np.random.default_rng([seed, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).poisson(n, draws)
                own = sums.setdefault(tuple(None if pd.isna(k) else k for k in key), np.zeros((2, draws)))
                own += np.stack([times * y, times])
                if len(sums) >= HELD:
                    yield told()
        if sums:
            yield told()

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in group], "side string, draw int, s double, w double"])
    seeded = df.select(*group, "side", "y", "n", F.xxhash64(*group, "side", "y").alias("h"))
    return seeded.mapInPandas(run, schema).groupBy(*group, "side", "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def tertile_effects(df: DataFrame, group: Sequence[str], x: str, y: str, ties: Sequence[str], least: int = 10, draws: int = DRAWS, seed: int = 13) -> DataFrame:
    """Per group: ``n, n_bottom, n_top, bottom_mean, top_mean, effect, ci_low, ci_high, reason``: the
    mean of ``y`` in the lowest third by (x, ties) less that in the highest, and its 95 %
    interval when each third is drawn anew. A third is max(1, n // 3) rows; ``ties`` (of any
    type) tell rows of one x apart. Rows without finite x and y are out; under ``least`` rows,
    or without spread of x, there is a reason and no effect. A Poisson draw that takes nothing of
    a third is left out of the interval. Rows of one value travel as one, and only a sum per
    draw, third and group meets."""
    pairs = df.select(*group, E.finite(F.col(x)).alias("__x"), E.finite(F.col(y)).alias("__y"), *[F.col(t).alias(f"__t{k}") for k, t in enumerate(ties)]).where("__x is not null and __y is not null")
    sizes = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.stddev_pop("__x").alias("sd"))
    reason = F.when(F.col("n") < least, f"insufficient_samples_n_lt_{least}").when(F.col("sd") <= SPREAD, "zero_variance")
    sizes = sizes.withColumn("reason", reason)
    order = [*group, "__x", *[f"__t{k}" for k in range(len(ties))]]
    placed = same_keys(numbered(pairs, order, group), sizes.where("reason is null"), group)
    third = F.greatest(F.lit(1).cast("long"), F.expr("n div 3"))
    side = F.when(F.col("position") < third, "bottom").when(F.col("position") >= F.col("n") - third, "top")
    # a third of one row each at most overlaps with n = 1, which is under any least
    by = placed.select(*group, side.alias("side"), F.col("__y").alias("y")).where("side is not null").groupBy(*group, "side", "y").agg(F.count("*").alias("n"))
    of = lambda s, v: F.sum(F.when(F.col("side") == s, v))
    n, total = F.col("n"), F.col("n") * F.col("y")
    means = by.groupBy(*group).agg(of("bottom", n).alias("n_bottom"), of("top", n).alias("n_top"), (of("bottom", total) / of("bottom", n)).alias("bottom_mean"), (of("top", total) / of("top", n)).alias("top_mean"))
    mean = lambda s: F.try_divide(of(s, F.col("s")), of(s, F.col("w")))
    differences = _drawn(by, group, draws, seed).groupBy(*group, "draw").agg((mean("bottom") - mean("top")).alias("d"))
    ends = differences.groupBy(*group).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))  # of ``draws`` values
    told = same_keys(means, ends, group)
    out = _left(sizes.select(*group, "n", "reason"), told, group)
    return out.select(*group, "n", "n_bottom", "n_top", "bottom_mean", "top_mean", (F.col("bottom_mean") - F.col("top_mean")).alias("effect"), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "reason")


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``left``, with what ``right`` has for its keys; null keys are equal."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys] or F.lit(True)  # without keys one row each
    return left.join(F.broadcast(named) if not keys else named, on, "left").drop(*[f"__right_{k}" for k in keys])
