"""k-means and held-out fits against numpy."""

import numpy as np
import pytest
from pavewise.operators import blocks, stats
from pyspark.sql import functions as F


def plain_lloyd(x, centres):
    for _ in range(300):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_lloyd_is_the_best_of_its_starts(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.6, (60, 2)) for c in ((0, 0), (6, 1), (3, 7), (9, 9))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(3)
    got = blocks.lloyd(df, "id", ["a", "b"], [1, 2, 3, 4, 5], starts=10)
    again = blocks.lloyd(df.repartition(7), "id", ["a", "b"], [4], starts=10)
    assert np.allclose(got[4], again[4]) and np.allclose(got[1], x.mean(0))
    for k, c in got.items():
        settled, cost = plain_lloyd(x, c)
        assert len(c) == k and np.allclose(settled, c, atol=1e-8)  # a fixed point
        best = min(plain_lloyd(x, x[rng.choice(len(x), k, replace=False)])[1] for _ in range(30))
        assert cost <= best * 1.02 and c.tolist() == sorted(c.tolist())
    label = {r["id"]: r["n"] for r in df.select("id", blocks.nearest(["a", "b"], got[4]).alias("n")).collect()}
    assert [label[i] for i in range(len(x))] == ((x[:, None] - got[4][None]) ** 2).sum(2).argmin(1).tolist()


def test_lloyd_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0), (4, None)], "id long, a double")
    assert blocks.lloyd(df, "id", ["a"], [1, 2, 3])[3].tolist() == [[0.0], [5.0]]
    assert len(blocks.lloyd(df.filter("false"), "id", ["a"], [2])[2]) == 0


def test_held_out_fits_equal_one_fit_each(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(300, 2)) + 0.4
    rows = [(i, float(a), float(b), int(i % 5), int((i // 5) % 5)) for i, (a, b) in enumerate(d)]
    df = spark.createDataFrame(rows, "id long, d_a double, d_b double, p int, q int")
    got = blocks.held_out_fits(df, ["d_a", "d_b"], "p", "q", [0, 3, 4])
    for g, w in zip([0, 3, 4], got, strict=True):
        one = stats.bradley_terry(df.filter((F.col("p") != g) & (F.col("q") != g)), ["d_a", "d_b"])
        assert np.allclose(w, list(one.values()), atol=1e-8)
    with pytest.raises(ValueError):
        blocks.held_out_fits(df.withColumnRenamed("d_a", "d_crime"), ["d_crime"], "p", "q", [0])
