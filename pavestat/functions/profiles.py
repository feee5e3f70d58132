"""Kernels on what is sampled along one line, NumPy only: smoothing that keeps real steps,
the course of a width, the pattern of the paint. Samples are 1-D arrays of one length.

Defined results: what is too short comes back as it is (smoothing) or is "unknown"; measures
without a value are None; samples without weight count nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

TINY = 1e-8
#: Fixed values of smoothing: widths of the two windows, degree, and what makes a spike.
MEDIAN_SPAN, SMOOTH_SPAN, DEGREE, LEAST = 9, 11, 3, 5
SPIKE_SCALES, SPIKE_FLOORS, TO_DEVIATION = 7.0, 4.0, 1.4826
#: Fixed values of width courses: samples in all and on a side, rounds, relative residual that
#: counts in full, gains of score and change that a course of more parts must bring.
WIDTH_SAMPLES, SIDE_SAMPLES, ROUNDS, FULL_RESIDUAL = 12, 6, 10, 0.045
LINEAR_GAIN, LINEAR_CHANGE = 2.5, 0.055
BENT_GAIN, BENT_CHANGE, BENT_RESIDUAL = 3.5, 0.12, 0.012
BENDS = (0.24, 0.76, 15)
#: Fixed values of patterns: weight of a sample that can be read, samples, their share, reach.
READABLE, READ_SAMPLES, READ_SHARE, READ_REACH = 0.22, 32, 0.45, 52.0
LEAST_RANGE, LEAST_CUT, MOST_CUT, USUAL_CUT = 0.06, 0.30, 0.62, 0.44
PERIODS, DUTIES, PHASES, DUTY_REACH = 34, 7, 24, 0.05
LEAST_PERIOD, MOST_CYCLES, CYCLES, CYCLE_SLACK, LEAST_DUTY, MOST_DUTY = 7.0, 12.0, 3.0, 0.15, 0.16, 0.78
SEEN, SEEN_AT, ON, ON_OVER_OFF = 0.30, 85.0, 0.30, 0.10
RUNS, GAPS, MOST_VARIATION, DASHED_GAIN = 3, 2, 0.85, 0.08
PERIODIC, PERIODIC_ALONE, PERIODIC_CYCLES, PERIODIC_GAIN = 0.16, 0.25, 4.5, 0.15
DOT_DUTY, DOT_CYCLES, DOT_RUN = 0.43, 5.0, 0.70
SOLID_MEAN, SOLID_SHARE = 0.46, 0.52


@lru_cache(maxsize=16)
def _hat(span: int, degree: int) -> np.ndarray:
    """What turns ``span`` values into those of their least-squares polynomial."""
    basis = np.linalg.qr(np.vander(np.linspace(-1, 1, span), degree + 1))[0]
    return basis @ basis.T


def _odd(most: int, n: int) -> int:
    return min(most, n - 1 + n % 2)


def despiked(values: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Values far from the median around them set to it, and which ones those are."""
    span = _odd(MEDIAN_SPAN, len(values))
    around = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(values, span // 2, mode="edge"), span), axis=1)
    off = values - around
    spread = TO_DEVIATION * np.median(np.abs(off - np.median(off)))
    spikes = np.abs(off) > max(SPIKE_SCALES * spread, SPIKE_FLOORS * floor)
    return np.where(spikes, around, values), spikes


def smoothed(values: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Values without spikes, then by moving polynomials of degree 3; at both ends the
    polynomial of the last window. Nothing reaches further than its window."""
    values = np.asarray(values, np.float64)
    n = len(values)
    if n < LEAST:
        return values.copy(), np.zeros(n, bool)
    clean, spikes = despiked(values, floor)
    span = _odd(SMOOTH_SPAN, n)
    hat, half = _hat(span, min(DEGREE, span - 2)), span // 2
    middle = np.lib.stride_tricks.sliding_window_view(clean, span) @ hat[half]
    return np.concatenate([hat[:half] @ clean[:span], middle, hat[half + 1 :] @ clean[-span:]]), spikes


def smoothed_curve(along: np.ndarray, across: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A curve in order of ``along``, one point a place (to nine digits), smoothed: places,
    values, and which were spikes."""
    order = np.argsort(along)
    t, first = np.unique(np.round(np.asarray(along, np.float64)[order], 9), return_index=True)
    return t, *smoothed(np.asarray(across, np.float64)[order][first], floor)


def _fits(designs: np.ndarray, y: np.ndarray, w: np.ndarray, full: float) -> tuple[np.ndarray, np.ndarray]:
    """Robust least squares of ``y`` by each of ``designs (m, n, k)``, all at once: the
    coefficients (m, k) and the weights (m, n) that they were found with. A design rests
    once a round moves it no more."""
    limit = max(full * max(float(np.median(y)), TINY), TINY)
    rcond = np.finfo(float).eps * max(designs.shape[1:])

    def solved(which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.maximum(weights, 0))
        return np.einsum("mkn,mn->mk", np.linalg.pinv(designs[which] * root[..., None], rcond=rcond), y * root)

    live = np.arange(len(designs))
    weights = np.tile(w, (len(designs), 1))
    found = solved(live, weights)
    for _ in range(ROUNDS):
        off = np.abs(y - np.einsum("mnk,mk->mn", designs[live], found[live])) / limit
        weights[live] = w / np.maximum(off, 1)
        new = solved(live, weights[live])
        moved = np.linalg.norm(new - found[live], axis=1)
        found[live] = new
        live = live[moved >= 1e-10]
        if not len(live):
            break
    return found, weights


def weighted_mean(x: np.ndarray, w: np.ndarray) -> float | None:
    total = float(w.sum())
    return None if total <= TINY else float((x * w).sum() / total)


def _weighted_step(x: np.ndarray, w: np.ndarray, share: float) -> float | None:
    """The least value that ``share`` of the weight is at or below."""
    use = np.isfinite(x) & np.isfinite(w) & (w > 0)
    if not use.any():
        return None
    order = np.argsort(x[use])
    reach = np.cumsum(w[use][order])
    return float(x[use][order][min(int(np.searchsorted(reach, share * reach[-1])), len(order) - 1)])


def width_course(along: np.ndarray, widths: np.ndarray, weights: np.ndarray, full: float = FULL_RESIDUAL) -> dict:
    """Whether a width stays, tapers or bends once: robust fits, chosen by BIC and by how much
    the richer course changes. ``course``, ``bic`` by course, ``margin`` to the next, ``bend``,
    ``expected`` widths. Bends are tried at 15 places, the best one stands."""
    s, y, w = (np.asarray(v, np.float64) for v in (along, widths, weights))
    nothing = {"course": "unknown", "bic": {}, "margin": None, "bend": None, "expected": None}
    if len(y) < WIDTH_SAMPLES or (y <= 0).any():
        return nothing
    t = (s - s.min()) / max(float(np.ptp(s)), TINY)
    n = max(float(w.sum() / max(w.max(), TINY)), 2.0)
    one = np.ones_like(t)
    places = np.linspace(*BENDS)
    sides = (t[None, :] <= places[:, None]).sum(axis=1)
    places = places[(sides >= SIDE_SAMPLES) & (len(y) - sides >= SIDE_SAMPLES)]
    designs = {"constant": (one[None, :, None], 1), "linear_taper": (np.stack([one, t], axis=1)[None], 2)}
    if len(places):
        designs["piecewise_transition"] = (np.stack([np.stack([one, t, np.maximum(t - c, 0)], axis=1) for c in places]), 4)
    courses = {}
    for name, (design, parts) in designs.items():
        coefficients, robust = _fits(design, y, w, full)
        for k, c in enumerate(coefficients):
            expected = design[k] @ c
            off = np.abs(y - expected) / np.maximum(expected, TINY)
            loss = weighted_mean(np.where(off <= full, 0.5 * off**2, full * (off - 0.5 * full)), w)
            if loss is None or (expected <= 0).any():
                continue
            bic = float(n * np.log(max(2 * loss, 1e-12)) + parts * np.log(n))
            if name not in courses or bic < courses[name]["bic"]:
                courses[name] = {"bic": bic, "expected": expected, "off": off, "weights": robust[k], "bend": float(places[k]) if parts == 4 else None}
    if "constant" not in courses:
        return nothing

    def change(ends: Callable[[np.ndarray], float], name: str) -> float:
        e = courses[name]["expected"]
        return abs(float(ends(e))) / max(float(np.median(e)), TINY)

    chosen = "constant"
    if "linear_taper" in courses and courses["constant"]["bic"] - courses["linear_taper"]["bic"] >= LINEAR_GAIN and change(lambda e: e[-1] - e[0], "linear_taper") >= LINEAR_CHANGE:
        chosen = "linear_taper"
    if "piecewise_transition" in courses:
        high = _weighted_step(courses[chosen]["off"], w, 0.9)
        gains = courses[chosen]["bic"] - courses["piecewise_transition"]["bic"] >= BENT_GAIN
        if gains and change(np.ptp, "piecewise_transition") >= BENT_CHANGE and high is not None and high >= BENT_RESIDUAL:
            chosen = "piecewise_transition"
    others = [c["bic"] for name, c in courses.items() if name != chosen]
    own = courses[chosen]
    return {"course": chosen, "bic": {name: c["bic"] for name, c in courses.items()}, "margin": min(others) - own["bic"] if others else None, "bend": own["bend"], "expected": own["expected"], "weights": own["weights"]}


def two_class_cut(values: np.ndarray) -> float:
    """The gray level, of 0 to 255, that parts ``values`` with the most variance between both
    sides; the first of equals."""
    count = np.bincount(np.clip(np.round(values * 255), 0, 255).astype(int), minlength=256) / len(values)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = 1 - below
    apart = np.zeros(256)
    real = (below > 1e-7) & (above > 1e-7)
    apart[real] = (mass[-1] * below[real] - mass[real]) ** 2 / (below[real] * above[real])
    return float(apart.argmax())


def painted(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Which samples are paint, and the cut of evidence: between two classes of what can be
    read, kept within bounds; the usual one where evidence hardly differs."""
    read = p[q >= READABLE]
    cut = USUAL_CUT
    if len(read) >= 2 and np.ptp(read) >= LEAST_RANGE:
        cut = float(np.clip(two_class_cut(read) / 255, LEAST_CUT, MOST_CUT))
    return p >= cut, cut


def runs(on: np.ndarray, readable: np.ndarray, s: np.ndarray) -> dict:
    """Number, mean, median and variation of the lengths of painted runs and of gaps. A run
    reaches to the sample after it; what cannot be read parts runs and is neither."""
    code = np.where(readable, np.asarray(on, int), -1)
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
    end = np.minimum(np.append(begin[1:], len(code)), max(len(code) - 1, 0))
    length = np.maximum(s[end] - s[begin], TINY) if len(code) else np.zeros(0)
    out = {}
    for name, kind in (("run", 1), ("gap", 0)):
        own = length[code[begin] == kind]
        mean = float(own.mean()) if len(own) else None
        out |= {f"{name}s": len(own), f"mean_{name}": mean, f"median_{name}": float(np.median(own)) if len(own) else None}
        out[f"{name}_cv"] = float(own.std() / max(mean, TINY)) if len(own) else None
    return out


def periodicity(p: np.ndarray, q: np.ndarray, s: np.ndarray, period: float) -> float:
    """Weighted correlation with itself one period on, from 0 to 1."""
    step = float(np.median(np.diff(s))) if len(s) > 1 else 1.0
    lag = round(period / max(step, TINY))
    if len(p) < 4 or period <= TINY or lag < 2 or lag >= len(p) - 2:
        return 0.0
    a, b, w = p[:-lag], p[lag:], q[:-lag] * q[lag:]
    if w.sum() <= TINY:
        return 0.0
    a, b = a - np.average(a, weights=w), b - np.average(b, weights=w)
    size = np.sqrt((w * a * a).sum() * (w * b * b).sum())
    return float(np.clip((w * a * b).sum() / size, 0, 1)) if size > TINY else 0.0


def periodic_fit(p: np.ndarray, q: np.ndarray, s: np.ndarray, run: float | None = None) -> dict | None:
    """The template of equal dashes nearest to ``p``, of a grid of periods, shares of paint
    and phases; shares are sought about the painted ``run`` if it is known. The first of
    equals stands; None where too little can be read or no period fits."""
    read = s[q >= READABLE]
    if len(read) < READ_SAMPLES:
        return None
    span = float(read[-1] - read[0])
    step = float(np.median(np.diff(s))) if len(s) > 1 else 1.0
    least, most = max(LEAST_PERIOD * step, span / MOST_CYCLES), span / max(CYCLES - CYCLE_SLACK, 1.0)
    if most <= least or span <= TINY:
        return None
    miss, hit, total = q * np.abs(p), q * np.abs(p - 1), max(float(q.sum()), TINY)
    phase_shares = np.linspace(0, 1, PHASES, endpoint=False)
    best = None
    for period in np.linspace(least, most, PERIODS):
        low, high = LEAST_DUTY, MOST_DUTY
        if run is not None:
            centre = float(np.clip(run / max(period, TINY), low, high))
            low, high = max(low, centre - DUTY_REACH), min(high, centre + DUTY_REACH)
        duties = np.linspace(low, high, DUTIES)
        at = np.mod(s[None, :] - (phase_shares * period)[:, None], period)
        template = at[None] < (duties * period)[:, None, None]
        score = np.clip(1 - np.where(template, hit, miss).sum(axis=2) / total, 0, 1)
        k = np.unravel_index(score.argmax(), score.shape)
        if best is None or score[k] > best["score"]:
            best = {"score": float(score[k]), "period": float(period), "duty": float(duties[k[0]]), "phase": float(phase_shares[k[1]] * period), "template": template[k]}
    return best | {"periodicity": periodicity(p, q, s, best["period"]), "cycles": span / max(best["period"], TINY)}


def _weighted_percentile(x: np.ndarray, w: np.ndarray, percent: float) -> float | None:
    use = w > TINY
    if not use.any():
        return None
    order = np.argsort(x[use])
    x, w = x[use][order], w[use][order]
    return float(np.interp(percent / 100 * w.sum(), np.cumsum(w) - 0.5 * w, x))


def paint_pattern(p: np.ndarray, q: np.ndarray, s: np.ndarray, told: str | None = None) -> dict:
    """Solid, dashed, dotted or unknown by the evidence of paint ``p`` with weights ``q`` at
    the places ``s``: a periodic template against an even line. Without visible paint nothing
    is inferred. ``told`` (a trusted pattern) goes before what is seen."""
    p, q, s = (np.asarray(v, np.float64) for v in (p, q, s))
    readable = q >= READABLE
    on, cut = painted(p, q)
    stats = runs(on, readable, s)
    count, share = int(readable.sum()), float(readable.mean()) if len(q) else 0.0
    reach = float(s[readable][-1] - s[readable][0]) if count >= 2 else 0.0
    mean, on_share = weighted_mean(p, q), weighted_mean(on.astype(float), q)
    peak = _weighted_percentile(p, q * readable, SEEN_AT)
    fit = periodic_fit(p, q, s, stats["median_run"])
    gain = None if fit is None or mean is None else fit["score"] - mean
    seen = peak is not None and peak >= SEEN and count >= READ_SAMPLES and share >= READ_SHARE and reach >= READ_REACH
    dashed = False
    if seen and fit is not None and gain is not None and gain >= DASHED_GAIN:
        bright, dark = (weighted_mean(p, q * side) for side in (fit["template"], ~fit["template"]))
        even = all(stats[c] is not None and stats[c] <= MOST_VARIATION for c in ("run_cv", "gap_cv"))
        repeats = stats["runs"] >= RUNS and stats["gaps"] >= GAPS and fit["cycles"] >= CYCLES
        periodic = fit["periodicity"] >= PERIODIC and (fit["periodicity"] >= PERIODIC_ALONE or (fit["cycles"] >= PERIODIC_CYCLES and gain >= PERIODIC_GAIN))
        stands_out = bright is not None and dark is not None and bright >= ON and bright - dark >= ON_OVER_OFF
        dashed = even and repeats and periodic and stands_out and LEAST_DUTY <= fit["duty"] <= MOST_DUTY
    kind = "unknown"
    if dashed:
        dots = fit["duty"] <= DOT_DUTY and fit["cycles"] >= DOT_CYCLES and stats["mean_run"] < DOT_RUN * stats["mean_gap"]
        kind = "dotted" if dots else "dashed"
    elif seen and mean is not None and mean >= SOLID_MEAN and on_share >= SOLID_SHARE:
        kind = "solid"
    pattern = told or kind
    broken = {"dashed", "dotted"}
    agrees = told is None or kind in (told, "unknown") or {kind, told} <= broken
    if pattern == "unknown":
        sure = 0.0
    elif told is not None:
        sure = min(0.72 + 0.23 * (1.0 if agrees and kind != "unknown" else 0.55) * min(share, 1.0), 0.98)
    elif pattern in broken:
        sure = 0.18 + 0.30 * fit["periodicity"] + 0.27 * min(gain / 0.35, 1.0) + 0.25 * min(fit["cycles"] / 6, 1.0)
        sure = min(sure, 0.96)
    else:
        sure = min(0.30 + 0.42 * on_share + 0.18 * (0.0 if gain is None else float(np.clip(-gain / 0.25, 0, 1))), 0.93)
    expected = fit["template"].astype(float) if pattern in broken and fit else np.ones_like(p) if pattern == "solid" else None
    source = "unknown" if pattern == "unknown" else "seen" if told is None else "told and seen" if agrees and kind != "unknown" else "told"
    fitted = {name: None if fit is None else fit[name] for name in ("period", "duty", "phase", "periodicity", "cycles")}
    return {"pattern": pattern, "source": source, "confidence": float(sure), "seen_pattern": kind, "conflict": not agrees, "cut": cut, "readable": count, "evidence": mean, "peak": peak, "on_share": on_share, "dashed_score": None if fit is None else fit["score"], "gain": gain, "expected": expected, **fitted, **stats}
