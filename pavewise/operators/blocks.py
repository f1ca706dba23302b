"""k-means over several numbers of clusters and starts at once, and fits that leave each group out at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.guard import check
from pavewise.session import checkpointed, importable

CHUNK = 4096


def _starts(points: DataFrame, d: int, ks: list[int], starts: int) -> list[np.ndarray]:
    """Centres of each (k, start), in that order: the k different points of the smallest draws."""
    most = max(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(starts)]
        for b in batches:
            x, h = np.stack([b.column(i).to_numpy() for i in range(d)], 1), b.column(d).to_numpy().view(np.uint64)
            for s in range(starts):
                z = (h ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                near = np.argsort(z, kind="stable")[: most * 8]
                best[s] = sorted({*best[s], *zip(z[near].tolist(), map(tuple, x[near].tolist()), strict=True)})[: most * 8]
        rows = [(s, str(z), list(p)) for s in range(starts) for z, p in best[s]]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["start", "z", "p"])

    got: dict[int, list] = {s: [] for s in range(starts)}
    for r in points.mapInArrow(run, "start int, z string, p array<double>").collect():  # 8 most a start and task
        got[r["start"]].append((int(r["z"]), tuple(r["p"])))
    found = []
    for k in ks:
        for s in range(starts):
            different = list(dict.fromkeys(p for _, p in sorted(got[s])))
            found.append(np.array(different[:k], float).reshape(-1, d))
    return found


def lloyd(df: DataFrame, key: str, cols: list[str], ks: list[int], starts: int = 10, seed: int = 1, rounds: int = 300, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """Centres for each k, of the start with the least squared distance; ordered by their coordinates.

    A start's first centres are drawn by hash of the key (rows that repeat a point draw with it as often). Each pass serves
    all runs that still move: a task adds up counts, sums and squared distances of its rows, and the driver gets a few
    numbers for each centre and task. Fewer different points than k are as many centres; an empty cluster keeps its centre.
    """
    importable(df.sparkSession)
    d = len(cols)
    points = checkpointed(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.xxhash64(F.col(key), F.lit(seed)).alias("_h")).na.drop())
    centres = _starts(points, d, ks, starts)
    moving, cost = [len(c) > 0 for c in centres], [math.inf] * len(centres)
    for _ in range(rounds):
        if not any(moving):
            break
        now = {i: c for i, c in enumerate(centres) if moving[i]}

        def run(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros((len(c), d + 2)) for i, c in now.items()}
            for b in batches:
                x = np.stack([b.column(i).to_numpy() for i in range(d)], 1)
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK]
                    for i, c in now.items():
                        gaps = ((part[:, None, :] - c[None]) ** 2).sum(2)
                        own = gaps.argmin(1)
                        for j, v in enumerate([np.ones(len(part)), *part.T, gaps[np.arange(len(part)), own]]):
                            total[i][:, j] += np.bincount(own, v, len(c))
            rows = [(i, k, total[i][k].tolist()) for i in now for k in range(len(now[i]))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[2][j] for r in rows], pa.float64()) for j in range(d + 2)]], ["run", "k", *[f"s{j}" for j in range(d + 2)]])

        sums = points.mapInArrow(run, "run int, k int, " + ", ".join(f"s{j} double" for j in range(d + 2))).groupBy("run", "k").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(d + 2)])
        got = {(r[0], r[1]): np.array(r[2:]) for r in sums.collect()}
        for i, c in now.items():
            each = np.stack([got[i, k] for k in range(len(c))])
            moved = np.where(each[:, :1] > 0, each[:, 1 : d + 1] / np.maximum(each[:, :1], 1), c)
            cost[i], moving[i], centres[i] = float(each[:, -1].sum()), bool(np.abs(moved - c).max() > tolerance), moved
    out = {}
    for n, k in enumerate(ks):
        best = min(range(n * starts, (n + 1) * starts), key=lambda i: (round(cost[i], 6), i))
        out[k] = np.array(sorted(centres[best].tolist())).reshape(-1, d)
    return out


def nearest(cols: list[str], centres: np.ndarray) -> Column:
    """The number of the nearest centre (the first of equal ones), as a column expression."""
    gaps = [sum((F.pow(F.col(c) - float(v), F.lit(2.0)) for c, v in zip(cols, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(g.alias("d"), F.lit(i).alias("i")) for i, g in enumerate(gaps)]))["i"]


def held_out_fits(pairs: DataFrame, cols: list[str], first: str, second: str, groups: list, strength: float = 1.0) -> np.ndarray:
    """(len(groups), len(cols)) weights of logistic preference models without intercept, fit g on the pairs of which neither side
    (columns first and second) is in group g; see stats.bradley_terry_fits. All fits share each Newton step."""
    check(cols)
    importable(pairs.sparkSession)
    d, fits = len(cols), len(groups)
    place = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))])
    rows = checkpointed(pairs.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], *[F.coalesce(place[F.col(c)], F.lit(-1)).alias(n) for c, n in ((first, "_p"), (second, "_q"))]).na.drop())
    w = np.zeros((fits, d))
    for _ in range(50):
        now = w

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((fits, d + d * d))
            for b in batches:
                x = np.stack([b.column(i).to_numpy() for i in range(d)], 1)
                sides = [b.column(d + i).to_numpy() for i in range(2)]
                for at in range(0, len(x), CHUNK):
                    xs = x[at : at + CHUNK]
                    p = 1 / (1 + np.exp(-np.clip(xs @ now.T, -500, 500)))
                    there = np.ones_like(p)
                    for side in sides:
                        own = side[at : at + CHUNK]
                        there[np.flatnonzero(own >= 0), own[own >= 0]] = 0
                    total[:, :d] += (there * (1 - p)).T @ xs
                    total[:, d:] += (there * p * (1 - p)).T @ (xs[:, :, None] * xs[:, None, :]).reshape(len(xs), -1)
            yield pa.record_batch([pa.array(np.arange(fits, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(d + d * d)]], ["fit", *[f"g{j}" for j in range(d + d * d)]])

        sums = rows.mapInArrow(run, "fit int, " + ", ".join(f"g{j} double" for j in range(d + d * d))).groupBy("fit").agg(*[F.sum(f"g{j}") for j in range(d + d * d)])
        got = np.zeros((fits, d + d * d))
        for r in sums.collect():
            got[r[0]] = r[1:]
        gradient = 2 * got[:, :d] - now / strength
        step = np.linalg.solve(2 * got[:, d:].reshape(fits, d, d) + np.eye(d) / strength, gradient[:, :, None])[:, :, 0]
        w = now + step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return w
