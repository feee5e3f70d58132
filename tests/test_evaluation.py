"""Roll-ups, profiles and closings on small tables with nulls, ties and empty groups."""

import pytest
from pyspark.sql import functions as F

from pavestat.operators import evaluation as V


def test_detection_and_confusion(spark):
    rows = [("a", 0.5, 1.0, 4.0, True), ("a", None, 9.0, 9.0, True), ("a", 0.1, 2.0, 4.0, None), (None, float("nan"), 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "g string, s double, m double, t double, f boolean")
    got = {r.g: r for r in V.detection(df, ["g"], F.col("s"), F.col("m"), F.col("t"), 0.2, 0.4, F.col("f")).collect()}
    a, none = got["a"], got[None]
    assert (a.images, a.eligible, a.any_high) == (3, 2, True)
    assert [a.available, a.fallbacks, a.rate, a["mean"], a.spread, a["median"], a.pooled] == pytest.approx([2 / 3, 0.5, 1 / 3, 0.3, 0.2, 0.3, 3 / 8])
    assert (none.images, none.eligible, none["median"], none.fallbacks, none.pooled) == (1, 0, None, None, None)
    assert V.detection(df.limit(0), [], F.col("s"), F.col("m"), F.col("t"), 0.2, 0.4).first().images == 0
    sides = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1), (1, None)], "t int, g int")
    c = V.confusion(sides, F.col("t"), F.col("g")).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 0, 1, 2) and [c.iou, c.iou_other, c.miou, c.recall, c.accuracy] == pytest.approx([1 / 2, 2 / 3, 7 / 12, 1 / 2, 3 / 4])
    assert V.confusion(sides.limit(0), F.col("t"), F.col("g")).first().miou == 0


def test_totals_profiles_and_runs(spark):
    lanes = spark.createDataFrame([("a", 3, 1, 0, 0.5), ("a", 1, 0, 4, None), ("b", 0, 0, 0, None)], "g string, tp int, fp int, fn int, acc double")
    got = {r.g: (r.n, r.precision, r.recall, r.f1, r.accuracy) for r in V.lane_totals(lanes, "tp", "fp", "fn", "acc", ["g"]).collect()}
    assert got["b"] == (1, 0, 0, 0, 0) and got["a"] == pytest.approx((2, 0.8, 0.5, 8 / 13, 0.5))
    cells = spark.createDataFrame([("n", "1"), ("n", "2.5"), ("n", None), ("t", "x"), ("m", "x"), ("m", "3"), ("e", None)], "g string, v string")
    kinds = {r.g: (r.n, r.kind, round(r.missing, 3), r.levels, r.q1) for r in V.profile(cells, ["g"], "v", "v").collect()}
    assert kinds == {"n": (3, "numeric", 0.333, 2, 1.75), "t": (1, "text", 1.0, 1, None), "m": (2, "mixed", 0.5, 2, 3.0), "e": (1, "empty", 1.0, 0, None)}
    runs = spark.createDataFrame([("y", 2.0, "b", True), ("y", 2.0, "a", True), ("y", 1.0, "c", False), ("y", None, "d", True), ("z", None, "e", True)], "o string, loss double, run string, ok boolean")
    assert [tuple(r) for r in V.best(runs, ["o"], "loss", "run", F.col("ok")).collect()] == [("y", "a")]
    assert len(V.seeded(spark.range(9), "id", 4, "s").collect()) == 4
    table = spark.createDataFrame([("m", "d1", 1.0), ("m", "d1", 3.0), ("m", "d2", 10.0), (None, "d1", 5.0)], "m string, d string, v double")
    assert {r.m: (r.groups, r.mean_of_means, r.q1) for r in V.rollup(table, "m", "d", "v", "v").collect()} == {"m": (2, 6.0, 3.0), None: (1, 5.0, 5.0)}


def test_matches_of_lanes(spark):
    lanes = spark.createDataFrame([(1, 1, [0.0, 1.0, 2.0, 3.0]), (2, 2, [0.0]), (3, 1, [])], "key int, image int, xs array<double>")
    others = spark.createDataFrame([(1, [0.01, 5.0, 2.0, 3.0]), (1, [0.0, 1.0]), (None, [0.0])], "image int, xs array<double>")
    assert dict(map(tuple, V.best_match(lanes, others, "image", "key", "xs", 0.05).collect())) == {1: 0.75, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_closings_fill_gaps_under_their_width(spark, width):
    states = [1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(states)] + [("b", 0, 0), ("c", 1, None)], "g string, k int, s int")
    got = [r.closed for r in V.closed(df, ["g"], ["k"], "s", width).where("g = 'a'").orderBy("k").collect()]
    want = list(states)
    gaps, start = [], None
    for k, v in enumerate(states):
        if v == 0 and start is None:
            start = k
        if v and start is not None:
            gaps.append((start, k))
            start = None
    for a, b in gaps:
        if b - a < width:
            want[a:b] = [1] * (b - a)
    assert got == want
