"""Operator 13 against numpy on whole tables."""

import numpy as np
import pytest
from pavewise.llm import whitening
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(n, dtype=float))):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        scale = max(1.0, np.abs(a).max() * n)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * scale) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)


def test_merge_is_one_pass():
    rng = np.random.default_rng(1)
    x = rng.normal(5, 3, (200, 6))
    parts = []
    for part in (x[:1], x[1:1], x[1:90], x[90:]):
        m = whitening.Moments.empty(6)
        m.add(part)
        parts.append(whitening.Moments.unpack(m.pack(), 6))
    whole = parts[3].merge(parts[0]).merge(parts[2]).merge(parts[1])
    assert whole.n == 200 and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


def plain(rows):
    """vec_id -> (deviation, projections) by numpy and Python integers."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float)
    values, vectors = np.linalg.eigh(np.cov(a.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    return n, {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), (np.array(x) - a.mean(0)) @ vectors / np.sqrt(values)) for i, x in good}, values / np.trace(np.cov(a.T, bias=True))


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(8, 8))
    rows = [(i, [float(np.float32(c)) for c in mix @ rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0] * 3), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40).select("*", F.lit("x").alias("VEC_ID"))
    n, want, shares = plain([r for r in rows if r[0] != 2005])
    out = whitening.whiten(df).toPandas()
    assert sorted(out.vec_id.unique()) == sorted(want) and len(out) == 4 * 451 and set(out.n) == {n} and set(out.component) == {1, 2, 3, 4}
    assert out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9
    first = out[out.vec_id == 0].set_index("component").whitened
    signs = {c: np.sign(first[c] * want[0][1][c - 1]) for c in first.index}
    for r in out.itertuples():
        deviation, w = want[r.vec_id]
        assert r.deviation == deviation and abs(r.whitened - signs[r.component] * w[r.component - 1]) < 1e-8 and abs(r.explained - shares[r.component - 1]) < 1e-10


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in one)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)} and {abs(r["whitened"]) for r in flat if r["component"] == 1} == {1.0}


def test_large_numbers_are_exact():
    rows = np.array([[2**40, -(2**20)]], np.int64)
    with pytest.raises(OverflowError):
        whitening._deviations(rows, 2**30, np.array([1, 1]))
    rows, sums = np.array([[3 * 2**20, 7]], np.int64), np.array([5, 9])
    assert whitening._deviations(rows, 900, sums)[0] == (900 * 3 * 2**20 - 5) ** 2 + (6300 - 9) ** 2
