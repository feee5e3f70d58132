"""Whitening against NumPy on whole matrices and exact integers."""

import numpy as np
import pytest

from pavestat.llm import whitening
from pavestat.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, n string"
BAD = [(1, None, "x", None), (2, [], None, "y"), (3, [1.0, None, 2.0], None, None), (4, [1.0, float("nan"), 2.0], None, None), (5, [float("inf"), 1.0, 2.0], None, None), (6, [1.0, 2.0], None, None), (7, [1e30, 0.0, 0.0], None, None)]


def exact(rows):
    x = np.floor(np.array(rows, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(c) for c in x.T.tolist()]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
    c = x - x.mean(axis=0)
    return n, sums, deviation, c, c.T @ c / n


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, _, deviation, c, v = exact([r.embedding for r in rows])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    want = c @ axes[:, :32] / np.sqrt(values[:32])
    place = {r.vec_id: k for k, r in enumerate(rows)}
    got = op11_whitening(spark, sf).collect()
    assert len(got) == 32 * len(rows)
    found = np.zeros((len(rows), 32))
    for r in got:
        k = place[r.vec_id]
        found[k, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = np.sign((found * want).sum(axis=0))
    assert np.abs(found * sign - want).max() < 1e-6
    assert np.abs(found.T @ found / n - np.eye(32)).max() < 1e-9


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    good = [(10 + k // 2, v, "w", "n") for k, v in enumerate(rng.normal(size=(40, 3)).tolist())] + [(None, [9.0, 9.0, -70000.5], None, None)]
    df = spark.createDataFrame(BAD + good, SCHEMA)
    model = whitening.fit(df)
    n, sums, deviation, _, v = exact([g[1] for g in good])
    assert (model.n, list(model.sums)) == (n, sums)
    assert model.trace == pytest.approx(np.trace(v), rel=1e-12)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "whitened", "deviation", "n"]
    got = out.collect()
    assert sorted(r.deviation for r in got) == sorted(deviation) and all(len(r.whitened) == 3 for r in got)
    assert sum(r.vec_id is None for r in got) == 1
    assert whitening.identity_error(df, model) < 1e-4  # variances from 4e3 to 5e11


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], None, None)] * 3, SCHEMA)
    model = whitening.fit(one)
    assert model.axes.shape == (2, 0) and whitening.identity_error(one, model) == 0
    assert [(r.whitened, r.deviation) for r in whitening.whiten(one, model).collect()] == [([], 0)] * 3
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], None, None) for k in range(9)], SCHEMA)
    model = whitening.fit(flat)
    assert len(model.values) == 1 and model.explained == [pytest.approx(1)]
    assert whitening.identity_error(flat, model) < 1e-9
    assert whitening.fit(spark.createDataFrame(BAD[:5], SCHEMA)) is None
    assert whitening.fit(one.limit(0)) is None


def test_sums_and_deviations_beyond_a_long():
    n = 1 << 40
    model = whitening.Whitening(n, (n * 1_000_000 + 3, n * 7), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1_000_000, 7], [1_000_001, 7], [1 << 50, 7]])
    assert model.deviation(x) == [9, None, None]
    small = whitening.Whitening(2, (3, 3), np.zeros(0), np.zeros((2, 0)), 0.0)
    assert small.deviation(np.array([[1, 2], [1 << 32, 1]])) == [2, None]
    assert small.centred(np.array([[1, 2]])).tolist() == [[-0.5, 0.5]]
