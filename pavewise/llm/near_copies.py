"""Near copies by exact Jaccard similarity of word shingles, candidates from SimHash first, then from other fingerprints.

A document is the set of its shingles' XXH64. Its SimHash is the majority of these hashes, and the sets whose SimHash differs in
max_bits or fewer bits are candidates by the pigeonhole plan of simhash.py. A pair is linked only if the Jaccard similarity of
the whole sets is LEAST or more, so dissimilar texts never link.

SimHash within few bits misses most pairs near LEAST, so what its links leave apart meets by a second kind of fingerprint. Each of
BANDS fingerprints hashes the set's smallest values under ROWS permutations of its own, so two sets of similarity s share one with
chance s ** ROWS: at 0.8 a pair shares none of all with chance (1 - 0.8 ** 5) ** 24 = 0.00007, less above. Documents that
share one are candidates too, compared only if no links connect them yet.

Equal sets are one row before the search, so copies never make pairs. Where over CROWD different sets share a
fingerprint, each is first compared with one pivot, the set that most of its crowded fingerprints have as their most typical one (that
of the largest share of crowded fingerprints). What that leaves in another component than most of a fingerprint's sets
is compared with all sets outside its component that can be similar at all: the bits in which the parity sketches
of two sets differ are no more than the shingles in which the sets do, and at 4/5 those are a ninth of the two sizes at most. So
every candidate pair is compared, known to be connected, or proved to be too different.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm import simhash
from pavewise.llm.common import documents, pick, prepare, stored
from pavewise.llm.graph import components
from pavewise.llm.simhash import MAX_BITS, keep_least, with_component

SHINGLE = 5
#: The least Jaccard similarity of a link, as a fraction: 4 / 5.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
CROWD = 30
#: Bits of a set's parity sketch, a power of two, and rounds of pivots before all pairs left are looked at.
BITS, ROUNDS = 1024, 1
#: Marks of sets that are broadcast (8 MB), to leave the other sets out before a shuffle; more sets are shuffled whole.
FEW = 1_000_000
#: Documents whose ids and text hashes are broadcast (some 20 MB) to read their texts without a shuffle; more meet by a shuffle.
FEW_TEXTS = 200_000
_RNG = np.random.default_rng(11)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Different XXH64 of all shingles in ascending order; words as in simhash.fingerprint, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k, plain = min(shingle, len(words)), b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(plain[a : e - 1], 42) for a, e in zip(starts, starts[k:], strict=False)], np.uint64))


def bands(found: np.ndarray) -> bytes:
    """BANDS fingerprints of 8 bytes each of a set that is not empty."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 512):
        least = np.minimum(least, (found[at : at + 512] * _ODD[:, None] + _ADD[:, None]).min(1))
    raw = least.tobytes()
    return b"".join(xxhash.xxh64_digest(raw[i : i + 8 * ROWS], i) for i in range(0, len(raw), 8 * ROWS))


def lists(values: list[bytes]) -> pa.Array:
    """One list of longs from each value's 8-byte numbers."""
    flat = np.frombuffer(b"".join(values), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(v) // 8 for v in values)]), pa.int32()), pa.array(flat))


def signatures(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, n, mark, bands): fp tells different sets apart, n is the set's size, mark its SimHash. Null text is empty."""
    prepare(df.sparkSession)
    docs = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, simhashes, marks = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, shingle)
                fps.append(xxhash.xxh64_digest(found.tobytes()))
                sizes.append(len(found))
                simhashes.append(simhash.majority(found.astype(">u8").view(np.uint8).reshape(-1, 8)))
                marks.append(bands(found) if len(found) else b"")
            fp, mark = pa.array(np.frombuffer(b"".join(fps), np.int64)), pa.array(np.frombuffer(b"".join(simhashes), ">i8").astype(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), fp, pa.array(sizes, pa.int32()), mark, lists(marks)], ["doc_id", "text_hash", "fp", "n", "mark", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, n int, mark long, bands array<long>")


def sketch(found: np.ndarray) -> bytes:
    """For each of BITS cells, whether an odd number of the set's hashes fall into it."""
    cells = (found * _ODD[0]) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=BITS) & 1 == 1).tobytes()


def sets_of(df: DataFrame, of: DataFrame, make: Callable[[str], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(fp, n, set, sketch) of the documents (doc_id, text_hash, fp) in of; make gives a text's set."""
    docs = pick(df, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    own = of.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), "fp")
    if own.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS:
        own = F.broadcast(own)
    texts = docs.join(own, docs["doc_id"].eqNullSafe(own["_id"]) & (docs["_hash"] == own["_of"])).dropDuplicates(["fp"]).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(t) for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int64())
            yield pa.record_batch([batch.column(0), sizes, lists([x.tobytes() for x in found]), lists([sketch(x) for x in found])], ["fp", "n", "set", "sketch"])

    return texts.mapInArrow(run, "fp long, n long, set array<long>, sketch array<long>")


def _similar(a: str, b: str):
    """Sizes that allow LEAST: the smaller set is at least that part of the larger one."""
    return F.least(a, b).cast("long") * LEAST[1] >= F.greatest(a, b).cast("long") * LEAST[0]


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, common) of pairs (a, b): the whole sets' sizes, and how many shingles they share."""
    one, two = (sets.select(F.col("fp").alias(k), F.col("n").alias(size), F.col("set").alias(x)) for k, size, x in (("a", "n", "x"), ("b", "m", "y")))
    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))


def linked(counted: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets have a Jaccard similarity of LEAST or more."""
    return counted.filter(F.col("common") * sum(LEAST) >= (F.col("n") + F.col("m")) * LEAST[0]).select("a", "b")


def _possible(x: str, y: str, n: str, m: str):
    """Whether sets of these sizes and sketches can have LEAST."""
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)])
    return apart * sum(LEAST) <= (F.col(n) + F.col(m)) * (LEAST[1] - LEAST[0])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have LEAST; sizes and sketches, far smaller than sets, rule most others out first."""
    one, two = (sets.select(F.col("fp").alias(k), F.col("n").alias(size), F.col("sketch").alias(x)) for k, size, x in (("a", "n", "x"), ("b", "m", "y")))
    near = pairs.join(one, "a").join(two, "b").filter(_similar("n", "m") & _possible("x", "y", "n", "m"))
    near = stored(near.select("a", "b"), "possible")
    wanted = stored(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted-sets")
    if wanted.limit(FEW + 1).count() <= FEW:
        sets = sets.join(F.broadcast(wanted), "fp", "left_semi")
    return linked(overlaps(near, sets))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connecting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs: one pair of each b first, then those that it left apart.

    Within a group of near copies the first pairs connect nearly all, so few of its pairs need the whole sets.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    found = stored(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets), "similar")
    return found.union(verified(unconnected(pairs, found), sets))


def simhash_pairs(one: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Candidates (a, b) among different sets (fp, mark): the least fp of each SimHash with its others, and with that of each SimHash linked to it."""
    least = stored(one.groupBy("mark").agg(F.min("fp").alias("least")), "simhash-marks")
    same = one.join(least, "mark").filter("fp <> least").select(*_ordered("least", "fp"))
    near = simhash.links(least.select(F.col("mark").alias("fp")), max_bits)
    one_end, other = (least.select(F.col("mark").alias(k), F.col("least").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    return stored(same.union(near.join(one_end, "a").join(other, "b").select(*_ordered("x", "y"))), "simhash-pairs")


def unconnected(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that the links found leave in different components."""
    if found.isEmpty():
        return pairs
    label = stored(components(found), "labels")
    one, two = (label.select(F.col("node").alias(k), F.col("label").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def links(df: DataFrame, rows: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, between the fp of rows (see signatures) whose components are those of all similar candidates."""
    one = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "text_hash")).alias("own"))
    one = stored(one.select("fp", "n", "mark", "bands", F.col("own.doc_id").alias("doc_id"), F.col("own.text_hash").alias("text_hash")), "different-sets")
    marked = simhash_pairs(one.filter("n > 0").select("fp", "mark"), max_bits)
    index = one.select("fp", "n", F.posexplode("bands").alias("band", "value"))
    shared = stored(index.groupBy("band", "value").agg(F.count("*").alias("k")).filter("k > 1"), "shared-fingerprints")
    members = stored(index.join(shared, ["band", "value"]), "candidates")
    quiet, crowded = members.filter(F.col("k") <= crowd), members.filter(F.col("k") > crowd)
    other = quiet.select(F.col("band").alias("_band"), F.col("value").alias("_value"), F.col("fp").alias("other"), F.col("n").alias("m"))
    near = quiet.join(other, (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")) & (F.col("fp") < F.col("other")) & _similar("n", "m"))
    wanted = members.select("fp").union(marked.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    sets = stored(sets_of(df, one.join(wanted, "fp", "left_semi"), lambda text: shingles(text, shingle), id_col, text_col), "shingle-sets")
    by_simhash = stored(connecting(marked, sets), "simhash-links")
    rest = unconnected(near.select(*_ordered("fp", "other")).distinct(), by_simhash)
    found = stored(by_simhash.union(connecting(rest, sets)), "similar")
    return found if crowded.isEmpty() else crowd_links(crowded.select(F.xxhash64("band", "value").alias("value"), "fp"), found, sets)


def _pivots(members: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set of members (value, fp) with one pivot."""
    share = members.groupBy("fp").count().join(small, "fp").select("fp", (F.col("count") / F.col("n")).alias("share"))
    typical = stored(members.join(share, "fp").groupBy("value").agg(F.max_by("fp", F.struct("share", "fp")).alias("pivot")), "pivots")
    met = members.join(typical, "value").groupBy("fp", "pivot").count().groupBy("fp").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    return met.filter("fp <> pivot").select(*_ordered("fp", "pivot")).distinct()


def _apart(crowded: DataFrame, close: DataFrame) -> DataFrame:
    """(value, fp, label, main) of the values whose sets have several components: each set's, and the one of most sets."""
    label = components(close).withColumnRenamed("node", "fp")
    placed = stored(crowded.join(label, "fp", "left").select("value", "fp", F.coalesce("label", "fp").alias("label")), "placed")
    most = placed.groupBy("value", "label").count().groupBy("value").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    several = stored(most.filter("labels > 1").select("value", F.col("most.label").alias("main")), "several")
    return stored(placed.join(several, "value").select("value", "fp", "label", "main"), "apart")


def crowd_links(crowded: DataFrame, found: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The links found, and those that connect the similar ones among crowded (value, fp)."""
    small = stored(sets.select("fp", "n", "sketch"), "sketches")
    crowded = stored(crowded.select("value", "fp").distinct(), "crowded")
    close, left = found, crowded
    for _ in range(rounds):
        close = stored(close.union(verified(_pivots(left, small), sets)).distinct(), "similar")
        apart = _apart(crowded, close)
        left = apart.filter("label <> main").select("value", "fp")
    sized = stored(apart.join(small, "fp"), "apart-sketches")
    rest = sized.filter("label <> main").toDF(*[f"_{c}" for c in sized.columns])
    can = (F.col("value") == F.col("_value")) & (F.col("label") != F.col("_label")) & _similar("n", "_n") & _possible("sketch", "_sketch", "n", "_n")
    return close.union(connecting(sized.join(rest, can).select(*_ordered("fp", "_fp")), sets))


def classes(df: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id): one row for each row of df, as simhash.classes gives them."""
    rows = stored(signatures(df, shingle, id_col, text_col), "signatures")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different-fp")
    label = components(links(df, rows, shingle, crowd, id_col, text_col)).withColumnRenamed("node", "fp")
    of_label = label.join(least, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    moved = label.join(of_label, "label").select("fp", "component_id")
    own = least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return with_component(rows.select("doc_id", "text_hash", "fp"), own)


def keep_one(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of near copies, as simhash.keep_one leaves it."""
    return keep_least(df, classes(df, shingle, CROWD, id_col, text_col), id_col, text_col)
