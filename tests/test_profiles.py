"""Kernels along one line: smoothing, width courses, paint patterns; by brute force and by
cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavestat.functions import profiles as P
from pavestat.operators import frames


@pytest.mark.parametrize("n", [5, 6, 9, 10, 11, 12, 40])
def test_smoothing_keeps_polynomials_and_takes_spikes_out(n):
    t = np.linspace(-1, 1, n)
    for degree in range(2 if n < 7 else 4):
        y = 3 + 2 * t**degree
        clean, spikes = P.smoothed(y, 10.0)
        assert np.allclose(clean, y, atol=1e-9) and not spikes.any()
    if n >= 9:
        y = 0.01 * t
        y[n // 2] += 5
        clean, spikes = P.smoothed(y, 0.1)
        assert spikes.tolist() == [k == n // 2 for k in range(n)] and np.abs(clean - 0.01 * t).max() < 0.02


def test_smoothing_is_the_moving_polynomial():
    y = np.random.default_rng(1).normal(size=30)
    clean, _ = P.smoothed(y, 1e9)
    for k in range(30):
        first = min(max(k - 5, 0), 19)  # the whole windows at both ends
        fit = np.polynomial.Polynomial.fit(range(first, first + 11), y[first : first + 11], 3)
        assert abs(fit(k) - clean[k]) < 1e-9
    assert P.smoothed(y[:4], 0.0)[0].tolist() == y[:4].tolist()
    t, line, spikes = P.smoothed_curve(np.array([3.0, 1, 2, 1, 0]), np.array([3.0, 1, 2, 1, 0]), 1.0)
    assert t.tolist() == line.tolist() == [0, 1, 2, 3] and len(spikes) == 4


def brute_fit(design, y, w, full):
    """One design, round by round, as the definition says."""
    limit = full * np.median(y)
    weights = w.copy()

    def solve():
        root = np.sqrt(weights)
        return np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]

    c = solve()
    for _ in range(P.ROUNDS):
        off = np.abs(y - design @ c)
        weights = np.array([a if o <= limit else a * limit / o for a, o in zip(w, off, strict=True)])
        new = solve()
        done = np.linalg.norm(new - c) < 1e-10
        c = new
        if done:
            break
    e = design @ c
    rel = np.abs(y - e) / e
    loss = np.average([0.5 * x * x if x <= full else full * (x - full / 2) for x in rel], weights=w)
    n = w.sum() / w.max()
    return n * np.log(max(2 * loss, 1e-12)), n


@pytest.mark.parametrize("seed", range(6))
def test_width_courses_are_the_robust_fits(seed):
    rng = np.random.default_rng(seed)
    s = np.sort(rng.uniform(0, 90, 40))
    w = rng.uniform(0.2, 1, 40)
    y = 20 + 0.05 * s * (seed % 2) + 0.3 * np.maximum(s - 50, 0) * (seed % 3 == 2) + rng.normal(size=40) * 0.2
    y[rng.integers(40, size=3)] *= 1.5
    found = P.width_course(s, y, w)
    t = (s - s[0]) / (s[-1] - s[0])
    score, n = brute_fit(np.ones((40, 1)), y, w, P.FULL_RESIDUAL)
    assert found["bic"]["constant"] == pytest.approx(score + np.log(n))
    score, n = brute_fit(np.stack([np.ones(40), t], 1), y, w, P.FULL_RESIDUAL)
    assert found["bic"]["linear_taper"] == pytest.approx(score + 2 * np.log(n))
    bent = {c: brute_fit(np.stack([np.ones(40), t, np.maximum(t - c, 0)], 1), y, w, P.FULL_RESIDUAL)[0] + 4 * np.log(n) for c in np.linspace(0.24, 0.76, 15) if min((t <= c).sum(), (t > c).sum()) >= 6}
    assert found["bic"]["piecewise_transition"] == pytest.approx(min(bent.values()))
    if found["course"] == "piecewise_transition":
        assert found["bend"] == pytest.approx(min(bent, key=bent.get))
    others = [v for k, v in found["bic"].items() if k != found["course"]]
    assert found["margin"] == pytest.approx(min(others) - found["bic"][found["course"]])


def test_width_courses_by_hand():
    s, one = np.arange(40.0), np.ones(40)
    noise = np.random.default_rng(2).normal(size=40) * 0.05
    assert P.width_course(s, 20 + noise, one)["course"] == "constant"
    assert P.width_course(s, 20 + 0.1 * s + noise, one)["course"] == "linear_taper"
    bent = P.width_course(s, 20 + np.maximum(s - 20, 0) * 0.5 + noise, one)
    assert bent["course"] == "piecewise_transition" and abs(bent["bend"] - 20 / 39) < 0.06
    assert P.width_course(s, 20 + 0.01 * s + noise * 0.01, one)["course"] == "constant"  # too little change
    for y in (20 * one[:11], np.append(one, 0)[1:], -one):
        assert P.width_course(s[: len(y)], y, one[: len(y)])["course"] == "unknown"
    assert P.width_course(0 * s, 20 + noise, one)["course"] == "constant"  # no length: a line adds nothing


def test_two_class_cut_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.clip(np.concatenate([rng.normal(0.2, 0.1, 30), rng.normal(0.7, 0.1, rng.integers(5, 40))]), 0, 1)
        levels = np.round(x * 255)
        apart = [(a.size * b.size * (a.mean() - b.mean()) ** 2, -t) if (a := levels[levels <= t]).size and (b := levels[levels > t]).size else (0, -t) for t in range(256)]
        assert P.two_class_cut(x) == -max(apart)[1]


def test_runs_reach_to_the_next_sample_and_stop_where_nothing_is_read():
    s = np.arange(10) * 2.0
    on = np.array([1, 1, 0, 0, 1, 1, 1, 1, 0, 1], bool)
    read = np.array([1, 1, 1, 1, 1, 0, 1, 1, 1, 1], bool)
    got = P.runs(on, read, s)  # painted 4, 2, 4 and the last sample of no length; gaps 4, 2
    assert (got["runs"], got["gaps"], got["mean_gap"], got["median_gap"]) == (4, 2, 3, 3)
    assert got["mean_run"] == pytest.approx(2.5) and got["gap_cv"] == pytest.approx(1 / 3)
    none = P.runs(on[:0], read[:0], s[:0])
    assert none["runs"] == none["gaps"] == 0 and none["mean_run"] is None


def brute_template(p, q, s, run):
    read = s[q >= P.READABLE]
    span, step = read[-1] - read[0], np.median(np.diff(s))
    best = None
    for period in np.linspace(max(7 * step, span / 12), span / 2.85, 34):
        duties = np.linspace(0.16, 0.78, 7)
        if run is not None:
            c = min(max(run / period, 0.16), 0.78)
            duties = np.linspace(max(0.16, c - 0.05), min(0.78, c + 0.05), 7)
        for duty in duties:
            for k in range(24):
                t = np.mod(s - k / 24 * period, period) < duty * period
                score = 1 - (q * np.abs(p - t)).sum() / q.sum()
                if best is None or score > best[0] + 1e-12:
                    best = score, period
    return best


@pytest.mark.parametrize("run", [None, 9.0])
def test_periodic_fit_is_the_best_of_the_grid(run):
    rng = np.random.default_rng(8)
    s = np.arange(70) * 1.5
    p = np.clip(0.8 * (np.mod(s, 21) < 9) + rng.normal(size=70) * 0.1, 0, 1)
    q = rng.uniform(0.1, 1, 70)
    got, want = P.periodic_fit(p, q, s, run), brute_template(p, q, s, run)
    assert got["score"] == pytest.approx(want[0]) and got["period"] == pytest.approx(want[1])
    assert abs(got["period"] - 21) < 1.5 and got["periodicity"] > 0.7
    assert P.periodic_fit(p[:20], q[:20], s[:20]) is None and P.periodic_fit(p, q * 0, s) is None


def test_patterns_by_hand():
    s, q = np.arange(100.0), np.ones(100)
    noise = np.random.default_rng(6).uniform(0, 0.04, 100)
    dash = P.paint_pattern(0.75 * (np.mod(s, 24) < 12) + noise, q, s)
    assert (dash["pattern"], dash["source"], dash["runs"]) == ("dashed", "seen", 5) and abs(dash["period"] - 24) < 1.5
    assert P.paint_pattern(0.75 * (np.mod(s, 14) < 3.5) + noise, q, s)["pattern"] == "dotted"
    solid = P.paint_pattern(0.8 + noise, q, s)
    assert solid["pattern"] == "solid" and solid["expected"].tolist() == [1.0] * 100
    assert solid["confidence"] == pytest.approx(0.3 + 0.42 + 0.18 * min(max(-solid["gain"] / 0.25, 0), 1)) or solid["confidence"] == 0.93
    dark = P.paint_pattern(0.1 * (np.mod(s, 24) < 12) + noise, q, s)
    assert (dark["pattern"], dark["source"], dark["confidence"], dark["expected"]) == ("unknown", "unknown", 0, None)
    told = P.paint_pattern(0.1 * (np.mod(s, 24) < 12) + noise, q, s, "dashed")
    assert (told["pattern"], told["source"], told["conflict"]) == ("dashed", "told", False) and told["confidence"] == pytest.approx(0.72 + 0.23 * 0.55)
    other = P.paint_pattern(0.8 + noise, q, s, "dashed")
    assert other["conflict"] and other["seen_pattern"] == "solid" and other["source"] == "told"
    both = P.paint_pattern(0.8 + noise, q, s, "solid")
    assert both["source"] == "told and seen" and both["confidence"] == pytest.approx(0.95)
    assert P.paint_pattern(0.8 + noise, q * 0.1, s)["pattern"] == "unknown"  # nothing can be read
    assert P.paint_pattern(noise[:0], q[:0], s[:0])["pattern"] == "unknown"


def test_operators_keep_rows_without_samples(spark):
    rows = [(1, [float(k) for k in range(40)], [20.0 + k % 2 * 0.01 for k in range(40)], None), (2, None, None, None), (3, [], [], "solid")]
    d = spark.createDataFrame(rows, "id long, s array<double>, y array<double>, told string")
    got = {x.id: x for x in frames.width_courses(d, "s", "y").collect()}
    assert got[1].course == "constant" and got[3].course == "unknown" and got[2].course is None and got[2].reason
    got = {x.id: x for x in frames.smoothed_lines(d, "s", "y", 1.0).collect()}
    assert got[1].spikes == 0 and len(got[1].smooth_across) == 40 and got[3].smooth_across == [] and got[2].reason
    seen = d.select("id", F.transform("y", lambda v: v / 25).alias("p"), F.transform("y", lambda v: F.lit(1.0)).alias("q"), F.transform("s", lambda v: v * 2).alias("s"), "told")
    got = {x.id: x for x in frames.paint_patterns(seen, "p", "q", "s", "told").collect()}
    assert got[1].pattern == "solid" and got[3].pattern == "solid" and got[2].pattern is None and got[2].reason
