"""Ranks, positions, regressions and sampling designs against numpy and pandas."""

import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pavewise.functions import expr as X
from pavewise.operators import design, forest, stats
from pavewise.sources import files
from pyspark.sql import functions as F


def test_ranks_equal_pandas(spark):
    values = [1.0] * 50 + [2.5, -7.0, None, 1e9, 2.5, 0.0, -0.25]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(5)
    got = {r["id"]: r["r"] for r in stats.average_ranks(df, "v", "r").collect()}
    for i, want in enumerate(pd.Series(values).rank()):
        assert got[i] == want if not np.isnan(want) else got[i] is None


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 2.0], [float("inf"), 1.0, float("-inf")]])
def test_ranks_of_few_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted(r["r"] for r in stats.average_ranks(df, "v", "r").collect()) == sorted(pd.Series(values, dtype=float).rank())


def test_positions_are_dense(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("_other"))
    got = stats.positions(df, ["k", "id"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(500))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(500))
    assert stats.positions(df.limit(0), ["k"], "at").count() == 0


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(2, 3, (200, 3))
    y = x @ [1.5, -2, 0.25] + 4 + rng.normal(0, 0.1, 200)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(float("nan"), 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (float("inf"), 1.0, 1.0, 1.0)]
    got = dict(stats.least_squares(spark.createDataFrame(rows, "a double, b double, c double, y double"), "y", ["a", "b", "c"]))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.lstsq(np.column_stack([z, np.ones(200)]), y, rcond=None)[0]
    assert np.allclose([got[c] for c in "abc"], want[:3], atol=1e-6)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, y double")
    assert dict(stats.least_squares(flat, "y", ["a"])) == {"a": 0.0}


def test_forest_predicts_every_row_out_of_its_group(spark):
    rows = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10) * 2).cast("double").alias("y"), (F.col("id") % 7).alias("cell"))
    out = forest.grouped_forest(rows, "y", ["x"], "cell", trees=10)
    assert out.count() == 120
    q = stats.fit_quality(out, "y", "out").first()
    assert q["n"] == 120 and q["r2"] > 0.9
    with pytest.raises(ValueError):
        forest.grouped_forest(rows.withColumnRenamed("x", "crime"), "y", ["crime"], "cell")


def test_seeded_pairs(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("p"), (F.col("id") % 5).cast("double").alias("q"))
    quotas = {"strong": 20, "mild": 15, "near": 15}
    got = design.seed_pairs(rows, "k", ("p", "q"), 5, 3, quotas).collect()
    again = design.seed_pairs(rows.repartition(7), "k", ("p", "q"), 5, 3, quotas).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    used = pd.Series([s for r in got for s in (r["a"], r["b"])]).value_counts()
    assert used.max() <= 3 and all(r["a"] < r["b"] for r in got)
    assert pd.Series([r["kind"] for r in got]).value_counts().to_dict() == quotas
    least = {k: min(r["d"] for r in got if r["kind"] == k) for k in quotas}
    assert least["strong"] > least["mild"] > least["near"]
    assert design.seed_pairs(rows.limit(1), "k", ("p", "q"), 5, 3, quotas).count() == 0


def test_round_robin(spark):
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") < 30, "a").otherwise("b").alias("s"))
    got = [(r["s"], r["turn"]) for r in design.round_robin(rows, "s", "id", 4, 7).collect()]
    assert got == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3), ("b", 3), ("a", 4)]


def test_tour(spark):
    rows = [(2, 9.0, 0.0), (4, 0.0, 0.0), (7, 3.0, 0.0), (9, 1.0, 0.0)]
    sites = spark.createDataFrame(rows, "seg_id long, mx double, my double")
    assert [r["seg_id"] for r in design.tour(sites).orderBy("stop").collect()] == [4, 9, 7, 2]
    assert [tuple(r) for r in design.tour(sites.filter("seg_id = 2")).collect()] == [(2, 1)]
    assert design.tour(sites.filter("false")).count() == 0
    with pytest.raises(Exception, match="over 3 sites"):
        design.tour(sites, 3).collect()
    rng = random.Random(4)
    many = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(35)]
    left, order = sorted(many, key=lambda s: (s[1], s[0])), []
    here = left[0]
    while left:
        order.append(here[0])
        left.remove(here)
        here = min(left, key=lambda s: (round(math.hypot(s[1] - here[1], s[2] - here[2]), 9), s[0]), default=None)  # noqa: B023
    got = design.tour(spark.createDataFrame(many, "seg_id long, mx double, my double")).orderBy("stop")
    assert [r["seg_id"] for r in got.collect()] == order

def test_expressions(spark):
    df = spark.createDataFrame([("2000", "A ROBBERY", [0, 1, 1, 3]), ("0600", None, []), ("0559", "x", None)], "t string, c string, m array<int>")
    got = df.select(X.night_clock(F.col("t")).alias("n"), X.any_of(F.col("c"), ("ROB",)).alias("a"), X.class_share(F.col("m"), 1).alias("s")).collect()
    assert [r["n"] for r in got] == [True, False, True]
    assert [r["a"] for r in got] == [True, None, False]
    assert [r["s"] for r in got] == [0.5, None, None]


def test_zip_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name,stop_lat\n1,\"A, B\",43.6\n2,C\n")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("readme.txt", "-")
    got = sorted(map(tuple, files.zip_member(spark, str(tmp_path), "stops.txt", ["stop_id", "stop_name", "stop_lat", "zone"]).collect()))
    assert got == [("1", "A, B", "43.6", None), ("2", "C", None, None)]
