"""Draws, greedy matching, budgets and partial correlations against sequential loops and numpy."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pavewise.operators import design, stats
from pyspark.sql import functions as F


def test_draws_are_uniform_and_keep_no_order(spark):
    got = [r["h"] for r in spark.range(4000).select(design.draw(13, "id").alias("h")).collect()]
    assert len(set(got)) == 4000 and 0 <= min(got) and max(got) < design.DRAWS
    cells = Counter(h * 16 // design.DRAWS for h in got)
    assert len(cells) == 16 and max(abs(n - 250) for n in cells.values()) < 80
    rank = pd.Series(got).rank()
    assert abs(np.corrcoef(rank, np.arange(4000))[0, 1]) < 0.06
    assert abs(np.corrcoef(rank[1:], rank[:-1])[0, 1]) < 0.06


def test_sides_differ_by_rater(spark):
    rows = spark.range(1000).select("id", F.explode(F.array(F.lit("human1"), F.lit("human2"), F.lit("ai:panel-r1"))).alias("rater"))
    sides = {(r["id"], r["rater"]): r["left"] for r in rows.select("*", (design.draw(17, "id", "rater") % 2 == 0).alias("left")).collect()}
    for one, two in (("human1", "human2"), ("human1", "ai:panel-r1")):
        same = sum(sides[i, one] == sides[i, two] for i in range(1000))
        assert 420 < same < 580
    runs = sum(sides[i, "human1"] == sides[i + 1, "human1"] for i in range(999))
    assert 420 < runs < 580


def test_twister_sides(spark):
    rows = [(p, r) for p in range(60) for r in range(3)]
    got = spark.createDataFrame(rows, "p long, r int").select("p", "r", design.twister_side(F.col("p"), F.col("r"), 8800089).alias("s")).collect()
    want = {(p, r): random.Random(((p * 2654435761) ^ (r * 40503) ^ 8800089) & 0xFFFFFFFF).random() < 0.5 for p, r in rows}
    assert {(g["p"], g["r"]): g["s"] for g in got} == want and len(set(want.values())) == 2


def sequential(offers, cap, quotas):
    ends, kinds, out = Counter(), Counter(), []
    for a, b, kind, h in sorted(offers, key=lambda o: (o[3], o[0], o[1])):
        if ends[a] < cap and ends[b] < cap and kinds[kind] < quotas.get(kind, 0):
            ends[a] += 1
            ends[b] += 1
            kinds[kind] += 1
            out.append((a, b, kind, h))
    return out


@pytest.mark.parametrize(("nodes", "cap", "share"), [(30, 2, 8), (30, 3, 1), (200, 1, 2), (4, 50, 8)])
def test_matching_equals_the_sequential_loop(spark, nodes, cap, share):
    """Small chunks, hot ends, kinds that fill at once or never, equal draws, a kind without a quota."""
    rng = random.Random(nodes)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(400)} | {(0, i) for i in range(1, nodes)}
    offers = [(a, b, rng.choice(("strong", "mild", "mild", "near", "none")), rng.choice((rng.randrange(design.DRAWS), design.DRAWS // 3))) for a, b in sorted(pairs)]
    quotas = {"strong": 12, "mild": 3, "near": 10_000}
    df = spark.createDataFrame(offers, "a long, b long, kind string, h long").repartition(3)
    got = sorted(map(tuple, design.matched(df, cap, quotas, share).select("a", "b", "kind", "h").collect()))
    assert got == sorted(sequential(offers, cap, quotas)) and got
    assert design.matched(df.limit(0), cap, quotas).count() == 0


def spent(rows, keep, cap, budget):
    """The loop over strata in turn: (id, turn, tries, kept)."""
    queues = {}
    for i, s, good, h in sorted(rows, key=lambda r: (r[3], r[0])):
        queues.setdefault(s, []).append((i, good))
    kept, tries, count, out, turn = 0, 0, Counter(), [], 0
    while kept < keep and tries < budget:
        turn, moved = turn + 1, False
        for s in sorted(queues):
            if not queues[s] or count[s] >= cap or kept >= keep:
                continue
            i, good = queues[s].pop(0)
            moved, tries = True, tries + 1
            if good:
                count[s] += 1
                kept += 1
            out.append((i, turn, tries, kept if good else None))
        if not moved:
            break
    return out


@pytest.mark.parametrize(("keep", "cap", "budget", "odds"), [(20, 4, 60, 0.5), (20, 4, 25, 0.2), (500, 3, 400, 0.9), (6, 9, 100, 1.0), (5, 5, 1, 0.5), (10, 5, 50, 0.0)])
def test_budget_equals_the_sequential_loop(spark, keep, cap, budget, odds):
    rng = random.Random(keep + budget)
    rows = [(i, rng.choice((0, 1, 1, 1, 2, 7)), rng.random() < odds, rng.randrange(40)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, s int, good boolean, h long").repartition(3)
    got = design.budgeted(df, "s", ["h", "id"], "good", keep, cap, budget).select("id", "turn", "tries", "kept").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == spent(rows, keep, cap, budget)


def test_running_sums(spark):
    df = spark.range(300).select(((F.col("id") * 37) % 101).alias("k"), "id", (F.col("id") % 5).alias("v"))
    got = stats.running(df, ["k", "id"], {"before": F.col("v"), "n": F.lit(1)}).orderBy("k", "id").collect()
    assert [r["n"] for r in got] == list(range(300)) and [r["before"] for r in got] == list(np.cumsum([0] + [r["v"] for r in got])[:-1])


def plain_partial(x, y, z):
    rank = lambda v: pd.Series(v).rank().to_numpy()
    design_matrix = np.column_stack([np.ones(len(x)), *[rank(c) for c in z]])
    left = [rank(v) - design_matrix @ np.linalg.lstsq(design_matrix, rank(v), rcond=None)[0] for v in (x, y)]
    return np.corrcoef(*left)[0, 1]


@pytest.mark.parametrize("controls", [1, 2, 3, 5])
def test_partial_correlation_of_any_number_of_controls(spark, controls):
    rng = np.random.default_rng(controls)
    z = [rng.integers(0, 9, 200).astype(float) for _ in range(controls)]
    x, y = sum(z) + rng.normal(size=200), -sum(z) + rng.normal(size=200)
    names = [f"z{i}" for i in range(controls)]
    rows = [tuple(map(float, r)) for r in zip(x, y, *z, strict=True)] + [(1.0, None, *[0.0] * controls)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["x", "y", *names]))
    got = stats.partial_spearman(df, "x", "y", names).first()
    assert got["n"] == 200 and abs(got["rho"] - plain_partial(x, y, z)) < 1e-9
    if controls == 2:  # a control that repeats another changes nothing; one that is x itself leaves nothing
        again = stats.partial_spearman(df.withColumn("w", F.col("z1") * 2), "x", "y", [*names, "w"]).first()
        assert abs(again["rho"] - got["rho"]) < 1e-6
        assert stats.partial_spearman(df, "x", "y", ["z0", "x"]).first()["rho"] is None
    assert stats.partial_spearman(df.limit(10), "x", "y", names).first()["rho"] is None
