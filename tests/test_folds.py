"""Folds by counting, greedy packing by the loop, and intervals of tertile effects."""

import collections
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavestat.operators import folds
from pavestat.operators.readiness import tertile_effects


def greedy(sizes, k):
    heap, loads, held = [(0, f) for f in range(k)], [0] * k, [0] * k
    for size in sorted(sizes, reverse=True):
        load, f = heapq.heappop(heap)
        loads[f], held[f] = load + size, held[f] + 1
        heapq.heappush(heap, (loads[f], f))
    return loads, held


@pytest.mark.parametrize("seed", range(30))
def test_packing_equals_the_greedy_loop(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 5, 8])
    sizes = [rng.choice([1, 1, 2, 3, 50, 700, rng.randrange(1, 40)]) for _ in range(rng.choice([k, 20, 400]))]
    loads, held = [0] * k, [0] * k
    places = collections.Counter()
    for size, f, first, end in folds.packed(list(collections.Counter(sizes).items()), k):
        loads[f], held[f] = loads[f] + size * (end - first), held[f] + end - first
        places[size] += end - first
    assert (loads, held) == greedy(sizes, k) and places == collections.Counter(sizes)


def test_packing_of_very_many_groups():
    assert {(size, end - first) for size, _, first, end in folds.packed([(1, 10**12), (10**11, 1)], 4)} == {(10**11, 1), (1, 275 * 10**9), (1, 175 * 10**9)}


def test_folds_are_balanced_in_each_class(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a"] * 8 + ["b", None]), "x") for k in range(501)] + [(7, "a", "x")] * 3
    df = spark.createDataFrame(rows, "id long, c string, position string")
    got = folds.balanced(df.select("id", "c"), 5, ["id"], "c")
    by = collections.defaultdict(lambda: [0] * 5)
    for r in got.collect():
        by[r.c][r.fold] += 1
    assert sum(map(sum, by.values())) == len(rows)
    assert all(max(n) - min(n) <= 1 for n in by.values())
    whole = [sum(n[f] for n in by.values()) for f in range(5)]
    assert max(whole) - min(whole) <= 1
    assert max(r.n for r in folds.sizes(folds.balanced(df.select("id"), 4, ["id"])).collect()) == 126
    with pytest.raises(ValueError):
        folds.balanced(df.limit(1).select("id"), 5, ["id"])
    # no more folds than rows of the smallest class
    few = spark.createDataFrame([(k, "a" if k else "b") for k in range(9)] + [(9, "b")], "id long, c string")
    assert {r.fold for r in folds.balanced(few, 5, ["id"], "c").collect()} == {0, 1}


def test_no_group_is_cut(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(40)]) if k % 3 else 99) for k in range(900)]
    got = folds.grouped(spark.createDataFrame(rows, "id long, g long"), 4, "g").collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r.g].add(r.fold)
    assert len(got) == 900 and all(len(f) == 1 for f in of.values())
    sizes = collections.Counter(g for _, g in rows)
    assert sorted(collections.Counter(r.fold for r in got).values()) == sorted(greedy(sizes.values(), 4)[0])
    three = spark.createDataFrame(rows[:30], "id long, g long").withColumn("g", F.col("id") % 3)
    assert {r.fold for r in folds.grouped(three, 5, "g").collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        folds.grouped(spark.createDataFrame([(1, 5)], "id long, g long"), 2, "g")


def test_intervals_cover_as_often_as_they_say(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(y), k) for g in range(150) for k, (x, y) in enumerate(zip(rng.normal(size=90), rng.normal(3, 1, size=90), strict=True))]
    df = spark.createDataFrame(rows, "g long, x double, y double, id long")
    got = tertile_effects(df, ["g"], "x", "y", ["id"], draws=300).collect()
    covered = sum(r.ci_low <= 0 <= r.ci_high for r in got) / len(got)
    assert len(got) == 150 and 0.86 <= covered <= 0.995
    width = np.mean([r.ci_high - r.ci_low for r in got])
    assert width == pytest.approx(2 * 1.96 * (2 / 30) ** 0.5, rel=0.1)
    again = {r.g: (r.ci_low, r.ci_high) for r in tertile_effects(df.repartition(3), ["g"], "x", "y", ["id"], draws=300).collect()}
    assert all(again[r.g] == pytest.approx((r.ci_low, r.ci_high), rel=1e-9) for r in got)


def test_effects_without_rows_or_spread(spark):
    rows = [("few", float(k), 1.0, k) for k in range(9)] + [("flat", 2.0, float(k), k) for k in range(20)] + [(None, float(k // 5), float(k), k) for k in range(30)] + [("few", None, 1.0, 1), ("gone", float("nan"), 1.0, 1)]
    got = {r.g: r for r in tertile_effects(spark.createDataFrame(rows, "g string, x double, y double, id long"), ["g"], "x", "y", ["id"], draws=100).collect()}
    assert got.keys() == {"few", "flat", None}
    assert got["few"].reason == "insufficient_samples_n_lt_10" and got["few"].effect is None and got["flat"].reason == "zero_variance"
    assert got[None].effect == -20 and got[None].n_bottom == 10 and got[None].ci_low < -20 < got[None].ci_high
    alone = tertile_effects(spark.createDataFrame(rows, "g string, x double, y double, id long").where("g is null"), [], "x", "y", ["id"], draws=100).collect()
    assert len(alone) == 1 and alone[0].effect == -20
