"""Per-image measures as columns. A kernel reads a row's PNG bytes or lanes in a worker and
gives counts; everything that is arithmetic on counts is a Column expression. Rows are
mapped, never shuffled, a few at a time, since each carries whole images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import expr as E
from ..functions import alignment, markings, profiles, raster
from . import localization, readiness

#: Rows of images that a worker is sent at once.
IMAGES = 16


def _mapped(df: DataFrame, schema: str, kernel: Callable[[dict], dict]) -> DataFrame:
    """``df`` with the columns of ``schema`` and ``reason`` at the end. A row whose kernel
    raises gets nulls and the reason; other rows are not touched by it."""
    new = T._parse_datatype_string(schema).fields + [T.StructField("reason", T.StringType())]

    types = to_arrow_schema(T.StructType(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(k, IMAGES)
                found = []
                for row in batch.to_pylist():
                    try:
                        found.append(kernel(row) | {"reason": None})
                    except Exception as e:  # one bad image must not end the run
                        found.append({"reason": f"{type(e).__name__}: {e}"})
                more = [pa.array([x.get(f.name) for x in found], f.type) for f in types]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *types.names])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(IMAGES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def _mask(data: bytes | None, like=None):
    if data is None:
        return None if like is None else like * 0
    m = raster.read_png(data)
    return (m.max(axis=2) if m.ndim == 3 else m) > 0


def mask_counts(df: DataFrame, pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Pixel counts of two PNG masks over the image and its near rows, and the numbers of
    their parts. A null mask is an empty one of the other's size; two nulls give nulls and
    a reason, as do sizes that differ."""

    def kernel(row: dict) -> dict:
        g = _mask(row[gt])
        p = _mask(row[pred], g)
        g = _mask(None, p) if g is None else g
        near = raster.near_rows(p.shape[0])
        if p.shape != g.shape:
            raise ValueError(f"masks of {p.shape} and {g.shape}")
        out = dict(zip(("tp", "fp", "fn"), raster.overlap(p, g), strict=True))
        out |= dict(zip(("near_tp", "near_fp", "near_fn"), raster.overlap(p[near], g[near]), strict=True))
        return out | {"pred_parts": raster.component_count(p), "gt_parts": raster.component_count(g)}

    return _mapped(df, "tp long, fp long, fn long, near_tp long, near_fp long, near_fn long, pred_parts long, gt_parts long", kernel)


def detection(df: DataFrame) -> DataFrame:
    """Detection, count, overlap, near-field and missed ratios from ``mask_counts``; null
    where the ground truth is empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    some = tp + fn > 0
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    near = F.col("near_tp") + F.col("near_fn") > 0
    return df.select(
        "*",
        (tp + fp > 0).cast("int").alias("detected"),
        F.when(F.col("gt_parts") > 0, F.least("pred_parts", "gt_parts") / F.greatest("pred_parts", "gt_parts")).alias("count_match"),
        F.when(some, F.try_divide(tp, tp + fp + fn)).alias("iou"),
        F.when(some, precision).alias("precision"),
        F.when(some, recall).alias("recall"),
        F.when(some, F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.when(near, F.try_divide(F.col("near_tp"), F.col("near_tp") + F.col("near_fp") + F.col("near_fn"))).alias("near_iou"),
        F.try_divide(fn, tp + fn).alias("missed_ratio"),
    )


def image_measures(df: DataFrame, image: str = "image", gt: str = "gt") -> DataFrame:
    """Contrast, sharpness and number of marking parts of an image under its mask."""

    def kernel(row: dict) -> dict:
        picture, mask = raster.read_png(row[image]), _mask(row[gt])
        return {"contrast": raster.contrast(picture, mask), "sharpness": raster.sharpness(picture, mask), "parts": raster.component_count(mask)}

    return _mapped(df, "contrast double, sharpness double, parts long", kernel)


def draw_lanes(df: DataFrame, lanes: str = "lanes", height: str = "height", width: str = "width", thickness: int = 16) -> DataFrame:
    """``lanes`` (arrays of x, y pairs) drawn as a PNG mask, and their x on the row grid."""

    def kernel(row: dict) -> dict:
        own = row[lanes]
        mask = raster.rasterise(own, int(row[height]), int(row[width]), thickness)
        return {"mask": raster.write_png(mask * 255), "grid_xs": raster.polyline_lanes(own, int(row[height]))}

    return _mapped(df, "mask binary, grid_xs array<array<int>>", kernel)


def mask_to_lanes(df: DataFrame, mask: str = "mask") -> DataFrame:
    return _mapped(df, "mask_xs array<array<int>>", lambda row: {"mask_xs": raster.mask_lanes(_mask(row[mask]))})


def line_accuracy(df: DataFrame, pred: str = "pred_xs", gt: str = "gt_xs", rows: str = "rows") -> DataFrame:
    """Accuracy and shares of wrong and missed lanes that are given by x at ``rows``."""

    def kernel(row: dict) -> dict:
        return dict(zip(("accuracy", "fp_share", "fn_share"), map(float, raster.line_scores(row[pred], row[gt], row[rows])), strict=True))

    return _mapped(df, "accuracy double, fp_share double, fn_share double", kernel)


def lane_matching(df: DataFrame, pred: str = "pred_lanes", gt: str = "gt_lanes", height: str = "height", width: str = "width") -> DataFrame:
    """Lanes found, wrong and missed by the IoU of drawn lanes, paired once each."""

    def kernel(row: dict) -> dict:
        return dict(zip(("lane_tp", "lane_fp", "lane_fn"), raster.lane_matches(row[pred], row[gt], int(row[height]), int(row[width])), strict=True))

    return _mapped(df, "lane_tp long, lane_fp long, lane_fn long", kernel)


def lane_width(df: DataFrame, lanes: str = "lanes", width: str = "width") -> DataFrame:
    """``width_stability`` of neighbouring lanes; null without two that share enough rows."""
    return _mapped(df, "width_stability double", lambda row: {"width_stability": raster.width_stability(row[lanes], int(row[width]))})


def _lanes(value) -> list[np.ndarray]:
    """Lanes of two points or more, from pairs or from structs of x and y."""
    out = []
    for lane in value or []:
        points = [(p["x"], p["y"]) if isinstance(p, dict) else tuple(p[:2]) for p in lane or [] if p is not None]
        points = [(float(x), float(y)) for x, y in points if x is not None and y is not None]
        if len(points) >= 2:
            out.append(np.array(points))
    return out


def grid_lanes(told) -> list[np.ndarray]:
    """Lanes of ``h_samples`` and the x of each lane there; x under 0 is no point."""
    if not told:
        return []
    rows = told["h_samples"] or []
    return _lanes([[(x, y) for x, y in zip(xs or [], rows, strict=False) if x is not None and x >= 0] for xs in told["lanes"] or []])


def _points(found: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in found]


def detection_records(df: DataFrame, pred: str = "pred", gt: str = "gt", pred_lanes: str | None = None, gt_json: str | None = None, prob: str | None = None, visibility: str | None = None, delta: float | None = None, widened: bool = True) -> DataFrame:
    """``df`` with the ``D1_`` to ``D7_`` columns of one prediction each. Lanes count by the
    lanes that are given, else by parts of the mask, and ``D2_pred_count_source`` tells which;
    the reference by ``gt_json``, else by its mask. D3, D4 and D6 compare the prediction
    widened to the reference's stroke. ``prob`` is float32 of the mask's pixels. With ``delta``
    also the localisation columns, by lanes or by the skeletons of the masks. A null mask is
    an empty one of the other's size; masks of other sizes are fitted."""

    def kernel(row: dict) -> dict:
        p, g = _mask(row[pred]), _mask(row[gt])
        if p is None and g is None:
            raise ValueError("neither mask is there")
        shape = (p if p is not None else g).shape
        raw, ref = markings.resized(p, shape), markings.resized(g, shape)
        own, told = _lanes(row[pred_lanes]) if pred_lanes else [], grid_lanes(row[gt_json]) if gt_json else []
        fitted, own_stroke, ref_stroke, was = markings.standardised(raw, ref) if widened else (raw, None, None, False)
        out = {"D1_pred_pixel_count": int(raw.sum()), "pred_lane_count": len(own), "D2_gt_lane_count": len(told) or raster.component_count(ref), "D2_pred_lane_count": len(own) or raster.component_count(raw)}
        out |= {"D2_pred_count_source": "native_polyline" if own else "connected_components", "pred_stroke_px": own_stroke, "gt_stroke_px": ref_stroke, "stroke_standardized": was}
        near = raster.near_rows(shape[0])
        out |= dict(zip(("D3_tp", "D3_fp", "D3_fn"), raster.overlap(fitted, ref), strict=True))
        out |= dict(zip(("near_tp", "near_fp", "near_fn"), raster.overlap(fitted[near], ref[near]), strict=True))
        chance = None if not prob or row[prob] is None else np.frombuffer(row[prob], "<f4").reshape(shape)
        out |= {"D7_confidence_mean": markings.confidence(chance, raw), "height": shape[0], "width": shape[1]}
        if delta is not None:
            (a, a_from), (b, b_from) = markings.centre_points(raw, own), markings.centre_points(ref, told)
            out |= {"pred_points": _points(a), "gt_points": _points(b), "D3p_pred_source": a_from, "D3p_gt_source": b_from}
        return out

    kind = "D1_pred_pixel_count long, pred_lane_count int, D2_gt_lane_count int, D2_pred_lane_count int, D2_pred_count_source string, pred_stroke_px double, gt_stroke_px double, stroke_standardized boolean, D3_tp long, D3_fp long, D3_fn long, near_tp long, near_fp long, near_fn long, D7_confidence_mean double, height int, width int"
    point = "array<struct<x: double, y: double>>"
    kind += f", pred_points {point}, gt_points {point}, D3p_pred_source string, D3p_gt_source string" if delta is not None else ""
    kept = [c for c in df.columns if c not in ("height", "width")]
    out = _mapped(df.select(*kept), kind, kernel)
    tp, fp, fn = F.col("D3_tp"), F.col("D3_fp"), F.col("D3_fn")
    some, near = tp + fn > 0, F.col("near_tp") + F.col("near_fn") > 0
    a, b = F.col("D2_pred_lane_count"), F.col("D2_gt_lane_count")
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    out = out.withColumns({
        "D1_detection": ((F.col("D1_pred_pixel_count") > 0) | (F.col("pred_lane_count") > 0)).cast("int"),
        "D2_count_match": F.when(b > 0, F.try_divide(F.least(a, b), F.greatest(a, b))),
        "D3_iou": F.when(some, F.try_divide(tp, tp + fp + fn)), "D3_precision": F.when(some, precision), "D3_recall": F.when(some, recall), "D3_f1": F.when(some, F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "D4_near_iou": F.when(near, F.try_divide(F.col("near_tp"), F.col("near_tp") + F.col("near_fp") + F.col("near_fn"))),
        "D6_gt_pixels": tp + fn, "D6_fn_pixels": fn, "D6_image_missed_ratio": F.try_divide(fn, tp + fn), "D_gt_eligible": some.cast("int"),
        "D5_visibility_group": E.visibility_group(F.col(visibility) if visibility else F.lit(None).cast("string")),
    })
    if delta is not None:
        out = localization.localise(out, "pred_points", "gt_points", "width", "height", delta).drop("pred_points", "gt_points")
    return out.drop("pred_lane_count", "near_tp", "near_fp", "near_fn")


def marking_records(df: DataFrame, image: str = "image", gt: str = "gt", lanes: str | None = None, gt_json: str | None = None, told: str | None = None) -> DataFrame:
    """``df`` with the ``I1_`` to ``I6_`` columns of an image and its reference: wear along the
    lanes, contrast, sharpness, lane width, legacy thickness, legacy bend, markings and their
    pattern. A null mask is empty, a mask of another size is fitted."""

    def kernel(row: dict) -> dict:
        picture = raster.read_png(row[image])
        shape = picture.shape[:2]
        mask, own = markings.resized(_mask(row[gt]), shape), _lanes(row[lanes]) if lanes else []
        guide, source = markings.guidance(shape, own, grid_lanes(row[gt_json]) if gt_json else [], mask)
        worn, thick = markings.wear(picture, guide), markings.thickness(mask)
        n, raw, topology = markings.topology(mask, own)
        width = raster.width_stability(guide, shape[1]) if guide else None
        return {
            "I1_pattern_continuity": worn["I1"], "I1_condition": worn["condition"], "I1_worn_fraction": worn["worn_fraction"], "I1_faded_fraction": worn["faded_fraction"], "I1_valid_lane_count": worn["valid_lane_count"],
            "I1_lane_count": worn["lane_count"], "I1_geometry_detail_source": source, "I1_unavailable_reason": worn["unavailable_reason"], "I2_local_contrast": raster.contrast(picture, mask), "I3_boundary_sharpness": raster.sharpness(picture, mask),
            "I4_lane_width_stability": width, "I4_legacy_thickness_stability": thick["score"], "I4_legacy_mean_thickness_px": thick["mean"], "I4_legacy_thickness_cv": thick["cv"], "I4_legacy_num_segments": thick["parts"],
            "I5_legacy_quadratic_proxy": markings.quadratic_bend(mask, own), "I6_marking_instance_count": n, "I6_raw_component_count": raw, "I6_topology_complexity": topology,
            "marking_pattern": markings.pattern(mask, own, row[told] if told else None)["pattern"], "gt_nonzero": int(mask.sum()),
        }

    kind = "I1_pattern_continuity double, I1_condition string, I1_worn_fraction double, I1_faded_fraction double, I1_valid_lane_count int, I1_lane_count int, I1_geometry_detail_source string, I1_unavailable_reason string, I2_local_contrast double, I3_boundary_sharpness double, I4_lane_width_stability double, I4_legacy_thickness_stability double, I4_legacy_mean_thickness_px double, I4_legacy_thickness_cv double, I4_legacy_num_segments int, I5_legacy_quadratic_proxy double, I6_marking_instance_count int, I6_raw_component_count int, I6_topology_complexity double, marking_pattern string, gt_nonzero long"
    return _mapped(df, kind, kernel)


def metric_records(df: DataFrame, image: str = "image", pred: str = "pred", gt: str = "gt", lanes: str | None = None, pred_lanes: str | None = None, gt_json: str | None = None, prob: str | None = None, visibility: str | None = None, delta: float | None = None, keep: tuple[str, ...] = ("sample_id", "dataset", "model_name")) -> DataFrame:
    """The record of each image: what ``marking_records`` and ``detection_records`` tell, both
    scores and the class. Images and masks are not kept; of other columns those in ``keep``."""
    one = marking_records(df, image, gt, lanes, gt_json).withColumnRenamed("reason", "marking_reason").drop(image)
    two = detection_records(one, pred, gt, pred_lanes, gt_json, prob, visibility, delta).withColumnRenamed("reason", "detection_reason")
    drop = {pred, gt, lanes, pred_lanes, gt_json, prob} - set(keep)
    own = two.drop(*[c for c in drop if c]).withColumn("pred_nonzero", F.col("D1_pred_pixel_count"))
    return readiness.scored(own.select(*[c for c in keep if c in own.columns], *[c for c in own.columns if c not in keep and c not in df.columns]))


def missed_masks(df: DataFrame, pred: str = "pred", gt: str = "gt", height: int | None = None, width: int | None = None) -> DataFrame:
    """``df`` with PNG masks of the reference, the prediction and what it misses, for review."""

    def kernel(row: dict) -> dict:
        g, p = _mask(row[gt]), _mask(row[pred])
        shape = (height, width) if height and width else (g if g is not None else p).shape
        return dict(zip(("gt_panel", "pred_panel", "missed_panel"), (raster.write_png(m.astype(np.uint8) * 255) for m in markings.missed(g, p, shape)), strict=True))

    return _mapped(df, "gt_panel binary, pred_panel binary, missed_panel binary", kernel)


def darkness(df: DataFrame, image: str = "image") -> DataFrame:
    """``df`` with the share of pixels whose brightest channel is under 100; null without an image."""

    def kernel(row: dict) -> dict:
        picture = raster.read_png(row[image])
        return {"dark_share": float(((picture.max(axis=2) if picture.ndim == 3 else picture) < 100).mean())}

    return _mapped(df, "dark_share double", kernel)


def smoothed_lines(df: DataFrame, along: str, across: str, floor: float) -> DataFrame:
    """``df`` with ``smooth_along`` and ``smooth_across``: a line's samples in order, one a
    place, without spikes and smoothed; ``spikes`` counts those replaced."""

    def kernel(row: dict) -> dict:
        t, y, spikes = profiles.smoothed_curve(np.array(row[along], float), np.array(row[across], float), floor)
        return {"smooth_along": t.tolist(), "smooth_across": y.tolist(), "spikes": int(spikes.sum())}

    return _mapped(df, "smooth_along array<double>, smooth_across array<double>, spikes int", kernel)


def width_courses(df: DataFrame, along: str, widths: str, weights: str | None = None, full: float = profiles.FULL_RESIDUAL) -> DataFrame:
    """``df`` with the course of a lane's width (``course``: constant, linear_taper,
    piecewise_transition, unknown), the score of each course, the ``margin`` to the next best,
    the place of the ``bend`` and the expected widths. Without ``weights`` samples weigh alike."""

    def kernel(row: dict) -> dict:
        y = np.array(row[widths], float)
        found = profiles.width_course(np.array(row[along], float), y, np.ones(len(y)) if weights is None else np.array(row[weights], float), full)
        scores = {f"bic_{short}": found["bic"].get(name) for short, name in (("constant", "constant"), ("linear", "linear_taper"), ("bent", "piecewise_transition"))}
        return {k: found[k] for k in ("course", "margin", "bend")} | scores | {"expected": None if found["expected"] is None else found["expected"].tolist()}

    return _mapped(df, "course string, margin double, bend double, bic_constant double, bic_linear double, bic_bent double, expected array<double>", kernel)


def paint_patterns(df: DataFrame, evidence: str, weight: str, along: str, told: str | None = None) -> DataFrame:
    """``df`` with the pattern of a marking by evidence of paint along it: ``pattern``, where
    it is from, ``confidence``, the cut of evidence, runs of paint and gaps, the fitted period
    and the ``expected`` template. ``told`` names a column of trusted patterns."""
    kinds = {"pattern": "string", "source": "string", "seen_pattern": "string", "conflict": "boolean", "readable": "int", "runs": "int", "gaps": "int", "expected": "array<double>"}
    numbers = ["confidence", "cut", "evidence_mean", "peak", "on_share", "dashed_score", "gain", "period", "duty", "phase", "periodicity", "cycles", "mean_run", "median_run", "run_cv", "mean_gap", "median_gap", "gap_cv"]

    def kernel(row: dict) -> dict:
        found = profiles.paint_pattern(row[evidence], row[weight], row[along], row[told] if told else None)
        expected = found["expected"]
        return found | {"evidence_mean": found["evidence"], "expected": None if expected is None else expected.tolist()}

    return _mapped(df, ", ".join(f"{k} {v}" for k, v in (kinds | dict.fromkeys(numbers, "double")).items()), kernel)


def curvature_courses(df: DataFrame, along: str, curvature: str, weight: str, tau: float, reach: int = 1) -> DataFrame:
    """``df`` with the diagnostics of a line's curvature, the kind of its course and the score
    of each kind; nulls where too few samples can be relied on."""

    def kernel(row: dict) -> dict:
        found = alignment.diagnostics(*(np.array(row[c], float) for c in (along, curvature, weight)), tau, reach)
        if found is None:
            return {"kind": "unknown"}
        told = alignment.course(found, tau)
        scores = {f"bic_{short}": told["bic"].get(name) for short, name in (("straight", "straight"), ("constant", "constant_curve"), ("linear", "transition_curve"), ("bent", "piecewise"))}
        return found | {k: told[k] for k in ("kind", "parts", "margin", "bend", "sure")} | scores

    numbers = [*alignment.PARTS, "p95_gradient", "heading_change", "curvature_rms", "curvature_std", "support", "margin", "bend", "sure", "bic_straight", "bic_constant", "bic_linear", "bic_bent"]
    return _mapped(df, "kind string, parts int, reversal_count int, " + ", ".join(f"{c} double" for c in numbers), kernel)


def alignments(df: DataFrame, lanes: str, height: str, width: str, space: str = "image_proxy", scale: str | None = None, objects: str | None = None) -> DataFrame:
    """``df`` with how its lanes bend: the image's complexity with its confidence, and a record
    of each lane. ``scale`` names a column of pixels a unit (else the image's diagonal),
    ``objects`` one of PNG masks of what hides the road."""

    def kernel(row: dict) -> dict:
        own = None if row[lanes] is None else [[(p["x"], p["y"]) if isinstance(p, dict) else p for p in x] for x in row[lanes]]
        found = alignment.image(own, (row[height], row[width]), space, row[scale] if scale else None, _mask(row[objects]) if objects else None)
        return found | {"lanes_told": found["lanes"]}

    words = {"kind": "string", "parts": "int", "reversal_count": "int", "reason": "string"}
    names = ["score", "confidence", "kind", "parts", "reversal_count", *alignment.PARTS, "p95_gradient", "heading_change", "curvature_rms", "curvature_std", "support", "tortuosity", "reason"]
    one = ", ".join(f"{x}: {words.get(x, 'double')}" for x in names)
    whole = "alignment_complexity double, complexity_confidence double, median_lane_complexity double, max_lane_complexity double, valid_lane_count int, unknown_lane_count int, unavailable_reason string"
    return _mapped(df, f"{whole}, lanes_told array<struct<{one}>>", kernel)
