"""Rows beside their successor in key order, with one shuffle: ranges of keys, and each range's next first row as a guest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import partitions

LEAST = -(1 << 63)


def _cut_points(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text hash) pairs that cut all rows into about n equal ranges, from a mergeable sketch over all rows.

    A key that fills several ranges alone is cut by hash, evenly; rows equal in both can't be cut apart.
    """
    shares = [i / n for i in range(1, n)]
    found = keys.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if shares else []
    pairs = [(int(k), LEAST + i * ((1 << 64) // int(times))) for k, times in zip(*np.unique(np.array(found or [], np.int64), return_counts=True), strict=True) for i in range(int(times))]
    return np.array([k for k, _ in pairs], np.int64), np.array([h for _, h in pairs], np.int64)


def _placed(cuts: tuple[np.ndarray, np.ndarray], keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each (key, hash)."""
    low, high = np.searchsorted(cuts[0], keys, "left"), np.searchsorted(cuts[0], keys, "right")
    for k in np.unique(keys[high > low]):
        at, rows = low[keys == k][0], keys == k
        low[rows] = at + np.searchsorted(cuts[1][at : high[rows][0]], hashes[rows], "right")
    return low


def with_next(df: DataFrame, n: int | None = None) -> DataFrame:
    """df (doc_id long, text) as rows (part, guest, key, hash, doc_id, text), dealt by part and sorted by (part, guest, key, hash).

    A part has a range of (key, text hash); the first row of the next part (of the first part, after the last) stands at its
    end with guest = true, as often as it occurs. Null doc_id is the smallest key. The driver holds two numbers for each part.
    """
    n = n or partitions(df)
    keyed = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    cuts = _cut_points(keyed.select("key"), n)

    @F.pandas_udf("int")
    def part_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, hashes in batches:
            yield pd.Series(_placed(cuts, keys.to_numpy(), hashes.to_numpy()).astype(np.int32))

    firsts = keyed.select("key", "hash").groupBy(part_of("key", "hash").alias("part")).agg(F.min(F.struct("key", "hash")).alias("first")).collect()
    first = {r["part"]: (r["first"]["key"], r["first"]["hash"]) for r in firsts}
    order = sorted(first)
    host = {first[p]: order[i - 1] for i, p in enumerate(order)}  # where the first row of part p is a guest

    @F.pandas_udf("array<int>")
    def parts_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, hashes in batches:
            own = _placed(cuts, keys.to_numpy(), hashes.to_numpy())
            pairs = zip(keys.tolist(), hashes.tolist(), strict=True)
            yield pd.Series([[int(p), -1 - host[k]] if k in host else [int(p)] for k, p in zip(pairs, own, strict=True)], dtype=object)

    rows = keyed.select(F.explode(parts_of("key", "hash")).alias("p"), "key", "hash", "doc_id", "text")
    rows = rows.select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("part"), (F.col("p") < 0).alias("guest"), "key", "hash", "doc_id", "text")
    return rows.repartitionById(len(cuts[0]) + 1, F.col("part")).sortWithinPartitions("part", "guest", "key", "hash")
