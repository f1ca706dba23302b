"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at max_bits or fewer differing bits. The bits are dealt into parts, each with its own
threshold t, so that the sum of t + 1 is max_bits + 1: two fingerprints that differ by more than t bits in every part
differ by more than max_bits altogether, so each linked pair meets in at least one part. Correlated bits share a part (their
collisions then spoil one part, which gets a low threshold or none), and thresholds come from dynamic programming on
candidate counts estimated from statistics of all fingerprints. Every part is indexed by its value and probed with all
values within its threshold; candidates are verified on all 64 bits.

Equal fingerprints are one row before the search, so copies never make pairs. Where many different fingerprints share a
part's value (over BUCKET of them), pairs would grow with the square: there, all fingerprints that index or probe the
value are linked through midpoints instead. Two of them within 2r bits have a point within r bits of both, and all within r
bits of a point are within 2r of each other, so linking each point's members to its smallest is exact, with a fixed number
of rows for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import documents, prepare, stored
from pavewise.llm.graph import components

BITS = 64
BUCKET = 4000
#: Numbers of parts among which the cheapest allocation is taken.
PARTS = (2, 3, 4, 5)
MAX_BITS = 4


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> bytes:
    """8 bytes, highest bit first: bit i is set if it is set in over half of the shingles' XXH64.

    A-Z are lower-cased; words are runs of anything but space and TAB..CR; shingles count as often as they occur; fewer
    words than a shingle form one shingle; no words give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    k, plain = min(shingle, len(words)), b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(plain[a : e - 1], seed) for a, e in zip(starts, starts[k:], strict=False)])
    return majority(np.frombuffer(raw, np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> bytes:
    """The bits that over half of the hashes have set; hashes are rows of 8 bytes, highest bit first. No hashes give 0."""
    counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed 64-bit number, text_hash tells rows of one doc_id apart. Null text is empty."""
    prepare(df.sparkSession)
    docs = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t, shingle) for t in batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]):
    return F.lit([_signed(x) for x in values]).cast("array<long>")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all rows; the driver gets these 4096 numbers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), 4096):
                x = np.unpackbits(raw[at : at + 4096], axis=1)[:, ::-1].astype(np.float32)
                total += x.T @ x
        cell = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.record_batch([pa.array(cell), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    out = np.zeros(BITS * BITS)
    for cell, n in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to parts of near equal width: a part starts with the bit left over and takes its most correlated ones."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [left.pop(0)]
        while len(group) < width:
            best = max(left, key=lambda b: (round(float(corr[b, group].mean()), 9), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def _within(agree: np.ndarray) -> np.ndarray:
    """P(at most t bits differ) for t = 0.., bits taken as independent with these chances to agree."""
    dist = np.zeros(len(agree) + 1)
    dist[0] = 1
    for a in agree:
        dist[1:] = dist[1:] * a + dist[:-1] * (1 - a)
        dist[0] *= a
    return np.cumsum(dist)


def allocate(costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 (-1: the part is not used) of least total cost with sum of t + 1 = max_bits + 1.

    costs[i][t] is part i's cost at threshold t. Dynamic programming over parts and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, max_bits - total + 1):
                if t < len(row):
                    now = (cost + (row[t] if t >= 0 else 0.0), [*ts, t])
                    if total + t + 1 not in step or now < step[total + t + 1]:
                        step[total + t + 1] = now
        best = step
    return best[max_bits + 1]


def plan(fps: DataFrame, n: int, max_bits: int, options: tuple[int, ...] = PARTS) -> list[tuple[int, list[int]]]:
    """(mask, xor masks of all values to probe) for each part in use, cheapest over the numbers of parts."""
    together = bit_statistics(fps)
    p = np.diag(together) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    grouped = {m: group_bits(together, n, m) for m in options}
    masks = {(m, k): sum(1 << b for b in g) for m, gs in grouped.items() for k, g in enumerate(gs)}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("value")) for i, x in enumerate(masks.values())])).alias("c")
    same = fps.select(cells).groupBy("c.part", "c.value").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    equal = {r["part"]: r["pairs"] for r in same.collect()}
    best = None
    for m, groups in grouped.items():
        costs = []
        for k, g in enumerate(groups):
            grow = _within(agree[g])
            candidates = equal.get(list(masks).index((m, k)), 0.0)
            costs.append([sum(comb(len(g), j) for j in range(t + 1)) * n + candidates * grow[t] / max(grow[0], 1e-12) for t in range(max_bits + 1)])
        cost, ts = allocate(costs, max_bits)
        if best is None or cost < best[0]:
            best = (cost, [(groups[k], t) for k, t in enumerate(ts) if t >= 0])
    return [(sum(1 << b for b in g), [sum(1 << b for b in c) for j in range(t + 1) for c in combinations(g, j)]) for g, t in best[1]]


def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _midpoints(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among these fingerprints that join whatever is within max_bits, through points within half of that.

    For odd max_bits one side's radius is a bit larger; members of a point are then verified against its smallest only
    where that is safe, so the larger radius is searched and pairs are taken between the two shells.
    """
    r = max_bits // 2
    flips = _longs([sum(1 << b for b in c) for j in range(r + 1) for c in combinations(range(BITS), j)])
    points = fps.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("point", "least")
    links = points.join(least, "point").filter("least < fp").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    if max_bits % 2 == 0:
        return links
    one = _longs([1 << b for b in range(BITS)])
    step = points.select("fp", F.explode(F.transform(one, lambda x: F.col("point").bitwiseXOR(x))).alias("point"))
    odd = step.join(least.unionByName(points.groupBy("point").agg(F.min("fp").alias("least"))), "point").filter(_near("fp", "least", max_bits) & (F.col("fp") != F.col("least")))
    return links.union(odd.select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b"))).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET, options: tuple[int, ...] = PARTS) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of distinct fp within max_bits.

    fps: one row for each different fp. Every pair outside crowded values is given; within those, links are given that
    connect the same fingerprints.
    """
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    parts = plan(fps, n, max_bits, options)
    at = lambda i, mask: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
    index = fps.select("fp", F.explode(F.array(*[at(i, mask) for i, (mask, _) in enumerate(parts)])).alias("k")).select(F.col("k.part").alias("part"), F.col("k.value").alias("value"), F.col("fp").alias("b"))

    def probed(i: int, mask: int, flips: list[int]):
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        return F.transform(_longs(flips), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("value")))

    probes = fps.select("fp", F.explode(F.concat(*[probed(i, mask, flips) for i, (mask, flips) in enumerate(parts)])).alias("k")).select(F.col("k.part").alias("part"), F.col("k.value").alias("value"), F.col("fp").alias("a"))
    crowded = stored(index.groupBy("part", "value").count().filter(F.col("count") > bucket).select("part", "value"), "crowded")
    if crowded.isEmpty():
        return probes.join(index, ["part", "value"]).filter((F.col("a") < F.col("b")) & _near("a", "b", max_bits)).select("a", "b").distinct()
    quiet = index.join(crowded, ["part", "value"], "left_anti")
    pairs = probes.join(quiet, ["part", "value"]).filter((F.col("a") < F.col("b")) & _near("a", "b", max_bits)).select("a", "b")
    # A probe that met a crowded value has its pairs there by midpoints; pairs that quiet values show are found either way.
    members = stored(probes.join(crowded, ["part", "value"], "left_semi").select(F.col("a").alias("fp")).distinct(), "crowd")
    return pairs.union(_midpoints(members, max_bits)).distinct()


def classes(df: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id): one row for each row of df, component_id the smallest doc_id reachable.

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat stay rows of their own. A null
    doc_id keeps its row; component_id is null only where a whole component has no doc_id. An empty table gives none. Very
    long texts are hashed shingle by shingle by the task that reads them; extra columns, whatever their names, are not looked at.
    """
    rows = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    of_label = linked.join(fps, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    moved = linked.join(of_label, "label").select("fp", "component_id")
    own = fps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return with_component(rows, own)


def with_component(rows: DataFrame, own: DataFrame, columns: tuple[str, ...] = ("doc_id", "text_hash", "fp")) -> DataFrame:
    """These columns of rows, fp among them, with own's component_id of their fp.

    own has one row for each fp and is written first: both sides then come to the join through plain exchanges, so a
    fingerprint that very many rows have is split over tasks by adaptive execution, and only own's one row is repeated.
    """
    return rows.join(stored(own, "component-of"), "fp").select(*columns, "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(df: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest (doc_id, text hash); repeated rows leave one.

    A null doc_id stands after all others. The columns of df come out as they went in.
    """
    return keep_least(df, classes(df, shingle, max_bits, id_col, text_col), id_col, text_col)


def keep_least(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with the least row of each component of found (doc_id, text_hash, fp, component_id); see keep_one.

    Of rows equal in id and text, but not in other columns, that of the least hash of all columns stays. They are
    combined before the one shuffle of texts, whose keys the join shares.
    """
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("apart")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))

    def keys(doc_id: str, text_hash: Column) -> list[Column]:
        return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.col(doc_id).isNull().alias("_none"), text_hash.alias("_hash")]

    wanted = stored(kept.select("k.*").select(*keys("doc_id", F.col("text_hash"))), "kept")
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    own = keys(f"c{names.index(id_col)}", F.xxhash64(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))))
    plain = [f.name for f in flat.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    one = flat.groupBy(*own).agg(F.min_by(F.struct(*flat.columns), F.xxhash64(*plain)).alias("row"))
    return one.join(wanted, ["_id", "_none", "_hash"], "left_semi").select("row.*").toDF(*names)
