"""Lanes to images and weighted quantiles against NumPy; sheets and codes of tags."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavestat.functions import taxonomy
from pavestat.operators import lanes, order
from pavestat.sources import sheets

SCHEMA = "image string, s double, c double, g double, u double, kind string, k double"


def made(seed, images=25):
    rng = random.Random(seed)
    kinds = ["constant", "piecewise_transition", "irregular_or_noisy", "merge_or_split_transition"]
    rows = []
    for i in range(images):
        for _ in range(rng.choice([1, 2, 3, 7])):
            rows.append((f"i{i}" if i else None, rng.choice([None, rng.random(), 0.5, float("nan")]), rng.choice([None, 0.0, rng.random()]), rng.random(), rng.choice([None, 0.0, 1.0, rng.random() * 500]), rng.choice(kinds[: 1 + i % 4]), rng.random()))
    return rows


def by_image(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def valid(rows):
    return [r for r in rows if r[1] is not None and np.isfinite(r[1])]


def weights(rows, factors, shortest=None):
    u = np.maximum([r[4] or 0.0 for r in rows], 1e-9)
    cap = 2 * np.median(u)
    cap = max(cap if shortest is None else min(cap, shortest * u.min()), 1e-9)
    w = np.sqrt(np.minimum(u, cap))
    for at, least in factors:
        w = w * np.maximum([r[at] or 0.0 for r in rows], least)
    return w if w.sum() > 1e-9 else np.ones(len(rows))


def step(v, w, q):
    order = np.argsort(v)
    total = np.cumsum(np.array(w)[order])
    return np.array(v)[order][min(np.searchsorted(total, q * total[-1]), len(v) - 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_to_images(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r.image: r for r in lanes.complexity(df, ["image"], "s", "c", "u").collect()}
    two = {r.image: r for r in lanes.width_stability(df, ["image"], "s", "k", "g", "c", "u", "kind").collect()}
    three = {r.image: r for r in lanes.continuity(df.withColumn("condition", F.when(F.col("k") < 0.5, "faded").otherwise("fine")), ["image"], "s", "c", "g", "u", "kind").collect()}
    assert one.keys() == two.keys() == three.keys() == by_image(rows).keys()
    for image, own in by_image(rows).items():
        here, a, b, c = valid(own), one[image], two[image], three[image]
        assert (a.valid_count, a.unknown_count) == (b.valid_count, b.unknown_count) == (len(here), len(own) - len(here)) and c.valid_count == len(here)
        if not here:
            assert a.alignment_complexity is None and a.complexity_confidence == 0 and a.unavailable_reason and b.stability is None and b.profile_type == "unknown" and c.condition == "unknown_condition" and c.pattern == "unknown"
            continue
        s, conf = np.array([r[1] for r in here]), np.array([r[2] or 0.0 for r in here])
        w = weights(here, [(2, 0.15)])
        assert [a.alignment_complexity, a.complexity_confidence, a.median, a.max] == pytest.approx([(w * s).sum() / w.sum(), (w * conf).sum() / w.sum(), np.median(s), s.max()])
        w = weights(here, [(3, 0.10), (2, 0.10)])
        stability = 0.65 * step(s, w, 0.5) + 0.35 * (w * s).sum() / w.sum()
        assert [b.stability, b.constancy, b.worst] == pytest.approx([stability, step([r[6] for r in here], w, 0.5), s.min()])
        kinds = {r[5] for r in here}
        assert b.profile_type == (kinds.pop() if len(kinds) == 1 else next((k for k in lanes.PROFILES if k in kinds), "piecewise_transition"))
        w = weights(here, [(2, 0.15), (3, 0.10)], 4.0)
        assert [c.continuity, c.worst] == pytest.approx([(w * s).sum() / w.sum(), s.min()])
        faded = {r[6] < 0.5 for r in here}
        assert c.condition == ("faded" if True in faded else "fine")


def test_small_images_meet_in_one_shuffle(spark, tmp_path):
    """sketches and joins for each of as many images as lanes took most of the time."""
    spark.createDataFrame(made(3), SCHEMA).write.parquet(str(tmp_path / "lanes"))
    df = spark.read.parquet(str(tmp_path / "lanes"))
    for found in (lanes.complexity(df, ["image"], "s", "c", "u"), lanes.width_stability(df, ["image"], "s", "k", "g", "c", "u", "kind"), lanes.continuity(df, ["image"], "s", "c", "g", "u", "kind", "kind")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan and "percentile_approx" not in plan


@pytest.mark.parametrize("held", [0, 2])
def test_large_images_beside_small_ones(spark, monkeypatch, held):
    monkeypatch.setattr(lanes, "HELD", held)
    rows = made(5)
    large = order.large_groups(spark.createDataFrame(rows, SCHEMA), ["image"], held)
    assert sorted(str(r.image) for r in large.collect()) == sorted(str(i) for i, own in by_image(rows).items() if len(own) > held)
    test_lanes_to_images(spark, 5)


def test_a_large_image(spark):
    rng = random.Random(4)
    rows = [("big" if i % 10 else f"i{i}", rng.choice([None, rng.gauss(0, 9), 1.0]), rng.random(), 0.5, rng.choice([1.0, rng.random() * 500]), "constant", rng.random()) for i in range(80_000)]
    got = {r.image: r for r in lanes.complexity(spark.createDataFrame(rows, SCHEMA), ["image"], "s", "c", "u").collect()}
    own = by_image(rows)
    assert got.keys() == own.keys() and len(own["big"]) > lanes.HELD
    here = valid(own["big"])
    s, w = np.array([r[1] for r in here]), weights(here, [(2, 0.15)])
    assert [got["big"].alignment_complexity, got["big"].median, got["big"].max, got["big"].valid_count] == pytest.approx([(w * s).sum() / w.sum(), np.median(s), s.max(), len(here)])


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_weighted_quantiles(spark, q):
    rng = random.Random(8)
    groups = {"a": [(rng.gauss(0, 1), rng.random()) for _ in range(3000)], "ties": [(5.0, 2.0)] * 900 + [(rng.choice([1.0, 5.0, 9.0]), rng.choice([0.5, 2.0])) for _ in range(100)], "one": [(3.0, 0.1)], None: [(1.0, 1.0), (1e12, 1.0), (2.0, 0.0), (4.0, -1.0)]}
    df = spark.createDataFrame([(g, *r) for g, rs in groups.items() for r in rs] + [("none", 1.0, 0.0), ("a", None, 5.0)], "g string, v double, w double")
    got = {r.g: r.quantile for r in lanes.midpoint_quantile(df, ["g"], "v", "w", q).collect()}
    steps = {r.g: r.quantile for r in lanes.weighted_quantile(df, ["g"], "v", "w", q).collect()}
    assert got.keys() == steps.keys() == groups.keys()
    for g, rs in groups.items():
        v, w = np.array(sorted(r for r in rs if r[1] > 0)).T
        assert got[g] == pytest.approx(np.interp(q * w.sum(), np.cumsum(w) - w / 2, v), rel=1e-9)
        assert steps[g] == pytest.approx(step(v, w, q), abs=1e-9)


def test_sheets(spark, tmp_path):
    head = '#,File Name,Scenario,"Context, Facility",Surface,Marking,Visibility,Weather,Solid Line,"Rain, heavy",Snow\n'
    body = ['1,a.jpg,Urban,"x, y",,,,,1,0,\n', "2, b.jpg ,,,,,,,0, 1 ,yes\n", "3,,,,,,,,1,1,1\n", ',"total, not idx",,,,,,,1,,\n', "5,TOTAL.jpg,,,,,,,,1,\n", ",TOTAL (count),,,,,,,2,2,1\n"]
    path = tmp_path / "s.csv"
    path.write_text(",,Summary,,,,,,Tags,,\n" + head + "".join(body), encoding="utf-8")
    got = {r.file_name: r for r in sheets.sheet(spark, str(path)).collect()}
    assert {k: (r.row_index, r.summary, r.labels) for k, r in got.items()} == {
        "a.jpg": (1, {"Scenario": "Urban", "Context, Facility": "x, y"}, ["Solid Line"]),
        "b.jpg": (2, {}, ["Rain, heavy", "Snow"]),
        "TOTAL.jpg": (5, {}, ["Rain, heavy"]),
    }
    assert sorted(map(tuple, sheets.totals(spark, str(path)).collect())) == [("Rain, heavy", 2, 2), ("Snow", 1, 1), ("Solid Line", 2, 1)]
    path.write_text(",,a\n" + head)
    assert sheets.sheet(spark, str(path)).count() == 0 and [r.stated for r in sheets.totals(spark, str(path)).collect()] == [None] * 3
    path.write_text("")
    assert sheets.sheet(spark, str(path)).count() == 0 and sheets.totals(spark, str(path)).count() == 0


def test_codes_of_tags(spark):
    words = taxonomy.every()
    assert len(words) == len(set(words)) == 43 and taxonomy.problems(taxonomy.TAXONOMY, taxonomy.TAXONOMY) == [] and taxonomy.KEYS.keys() == taxonomy.TAXONOMY.keys()
    odd = {"A": ["x", "y"], "B": ["y"]}
    assert taxonomy.problems(odd, {"A": ["x", "z"], "C": []}) == ["missing dimension: B", "extra dimension: C", "[A] tag without a definition: y", "[A] definition without a tag: z", "repeated tag: y"]
    rows = [(0, ["Rain", "Nighttime", "Rain", None, "what", "Urban", "what"]), (1, None), (2, []), (3, words[::-1])]
    df = spark.createDataFrame(rows, "id int, l array<string>").withColumn("e", taxonomy.encoded(F.col("l")))
    got = df.select("id", "e.*", taxonomy.decoded(F.col("e.multi_hot")).alias("back"), taxonomy.unknown(F.col("l")).alias("unknown"), taxonomy.from_codes(F.col("e.codes.lighting_weather"), taxonomy.TAXONOMY["Lighting & Weather"]).alias("weather")).orderBy("id").collect()
    assert got[0].codes.lighting_weather == [2, 6] and got[0].primary.lighting_weather == 2 and got[0].primary.surface == 0 and got[0].codes.context == [5]
    assert got[0].back == ["Urban", "Nighttime", "Rain"] and got[0].unknown == ["what"] and got[0].weather == ["Nighttime", "Rain"]
    assert all(r.back == [] and sum(r.multi_hot) == 0 and r.primary.visibility == 0 for r in got[1:3])
    assert got[3].back == words and got[3].codes.marking == list(range(1, 10))
    assert df.select(taxonomy.decoded(F.array(F.lit(1))).alias("d")).first().d is None
