"""Order statistics, ranks and positions against NumPy and sorting."""

import collections
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavestat.operators import order
from pavestat.operators.relational import tertile_effect


def columns():
    rng = random.Random(2)
    heavy = [rng.gauss(0, 1) for _ in range(6000)] + [1e12, -1e15, 3e300]
    ties = [5.0] * 5400 + [rng.choice([1.0, 2.0, 7.5, 9.0]) for _ in range(600)]
    return {"heavy": heavy, "ties": ties, "one": [3.0], "two": [1.0, 2.0], "steps": [float(k // 7) for k in range(2000)], None: [2.0, float("nan"), float("inf"), 4.0]}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, v) for g, vs in columns().items() for v in vs] + [("heavy", None), ("empty", None)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


@pytest.mark.parametrize(("accuracy", "held"), [(10_000, 1 << 20), (50, 1 << 20), (50, 40)])
def test_percentiles_equal_numpy(values, monkeypatch, accuracy, held):
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    monkeypatch.setattr(order, "HELD", held)
    qs = [0.0, 0.025, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: list(r)[1:] for r in order.percentiles(values, ["g"], F.col("v"), qs).collect()}
    want = {g: [np.quantile([v for v in vs if np.isfinite(v)], q) for q in qs] for g, vs in columns().items()}
    assert got.keys() == want.keys()
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=1e-12)


def test_a_bracket_holds_few_rows_whatever_the_outliers(values, monkeypatch):
    """What one task orders is bounded by ranks, not by the range of values."""
    found = order.values_at(values.where("g = 'heavy'"), ["g"], F.col("v"), [0.5], [[F.lit(3001)]]).collect()
    assert [(r.rank, r.n, r.size) for r in found] == [(3001, 1, 6003)]
    parts = order.split(values.where("g = 'heavy' and v is not null").select("g", "v").distinct(), ["g"], "v", 64).groupBy("__part").count().collect()
    assert len(parts) == 64 and max(r["count"] for r in parts) < 3 * 6003 / 64


def test_ranks_and_spearman(values):
    def ranks(vs):
        vs = np.array(vs)
        return {v: (vs < v).sum() + ((vs == v).sum() + 1) / 2 for v in set(vs.tolist())}

    own = values.where("v is not null and not isnan(v)")
    got = {(r.g, r.v): r.rank for r in order.average_ranks(own, ["g"], "v", "rank").collect()}
    want = {(g, v): k for g, vs in columns().items() for v, k in ranks([x for x in vs if x == x]).items()}
    assert got == want
    pairs = own.where("g in ('heavy', 'ties')").withColumn("w", F.floor(F.col("v")) % 5)
    found = order.ranked_pairs(pairs, ["g"], "v", "w").collect()
    by = collections.defaultdict(list)
    for r in pairs.collect():
        by[r.g].append((r.v, r.w))
    for g, rows in by.items():
        rx, ry = ranks([a for a, _ in rows]), ranks([b for _, b in rows])
        n = collections.Counter(rows)
        assert {((r.v, r.w), r["__n"], r["__rx"], r["__ry"]) for r in found if r.g == g} == {(p, n[p], rx[p[0]], ry[p[1]]) for p in n}


def test_places_by_several_columns(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1.5, 2.0, 2.0, 1e9]), rng.randrange(4), k) for k in range(900)]
    df = spark.createDataFrame([*rows, (None, 1, 1), (2.0, None, 5)], "a double, b int, c long")
    for k in (0, 1, 299, 450, 899):
        assert tuple(order.place(df, ["a", "b", "c"], k)) == sorted(rows)[k]
    assert order.place(df, ["a", "b", "c"], 900) is None and order.place(df.limit(0), ["a"], 0) is None


def test_tertiles_of_tied_values(spark):
    rows = [(1.0 if k < 95 else 2.0, float(k % 13), k) for k in range(100)]
    got = tertile_effect(spark.createDataFrame(rows, "x double, y double, id long"), "x", "y", ["id"]).first()
    assert got.n == 100 and got.effect == pytest.approx(np.mean([r[1] for r in rows[:33]]) - np.mean([r[1] for r in rows[67:]]))


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)"])
def test_positions_by_keys_of_any_type(spark, kind):
    rng = random.Random(7)
    keys = [rng.randrange(60) for _ in range(3000)]
    make = {"string": lambda k: f"key {k}" if k else None, "date": lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)}.get(kind, lambda k: k)
    rows = [(make(k) if kind != "decimal(20,3)" else None, k, i, "g" if i % 3 else None) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, f"key {kind if kind != 'decimal(20,3)' else 'string'}, k int, id long, g string")
    if kind == "decimal(20,3)":
        df = df.withColumn("key", F.col("k").cast(kind))
    got = order.numbered(df, ["key", "id"]).collect()
    want = sorted(range(3000), key=lambda i: ((rows[i][0] is not None, rows[i][0] or "") if kind == "string" else (keys[i],), i))
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == want and sorted(r.position for r in got) == list(range(3000))
    within = order.numbered(df, ["g", "key", "id"], ["g"]).collect()
    for g in ("g", None):
        own = sorted((r for r in within if r.g == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and [r.id for r in own] == [i for i in want if rows[i][3] == g]


def test_positions_are_balanced(spark, monkeypatch):
    """A first column of one value does not put all rows into one partition."""
    kept = []
    monkeypatch.setattr(order, "written", lambda df, name, run=order.written: kept.append(run(df, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 40_000, 1, 8).select(F.lit("same").alias("key"), F.col("id"))
        assert order.numbered(df, ["key", "id"]).where("position <> id").count() == 0
        parts = kept[0].groupBy(F.shiftright("__at", 33)).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
