"""Documents linked at an exact Jaccard similarity of 4/5 or more on five-word shingles, by PartEnum signatures.

Sizes are cut into bands whose ends grow by GROW; a set belongs to its own band's instance, and to the next one's if a set there
can be similar to it. Within an instance similar sets differ in k features at most (a ninth of two sets of the band's
largest size). The feature domain is hashed into N > k + 1 parts, so at least N - k parts agree in full: a set's signatures are the
contents of its parts, one subset of the second level each (larger subsets would only make more of them).

Two rules about contents keep signatures telling, and lose nothing since equal parts follow them alike. A part that is empty
or has frequent shingles alone gives no signature. A set that has N - k or more of those could agree with another in them alone, so it
adds the prefix signatures of its order (rare shingles first): a - ceil(4a/5) + 1 features, of which similar sets share one. So every
pair of similar sets shares a signature, whichever shingles are called frequent.

Which are, and which signatures are dealt out by set because very many sets share them, is found on one text in SAMPLE; both
lists hold MOST entries at most and change the work, never the links. Signatures that CROWD sets or fewer share give pairs;
for larger groups see near_copies. All pairs are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm import near_copies
from pavewise.llm.common import discard, documents, pick, prepare, stored
from pavewise.llm.graph import components
from pavewise.llm.near_copies import CROWD, LEAST, SHINGLE
from pavewise.llm.simhash import with_component

#: A band's largest size is this fraction of its smallest.
GROW = (8, 5)
SAMPLE = 32
#: Sampled texts that share a frequent shingle, and sampled sets that share a signature dealt out by set, at least.
FREQUENT, SHARED = 3, 16
MOST = 200_000
#: Words whose hashes, and sets whose marks, a task remembers.
REMEMBERED = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.empty(0, np.uint64)


def bands(most: int = 1 << 40) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band, from 1 on."""
    out = [(1, 1)]
    while out[-1][1] < most:
        low = out[-1][1] + 1
        out.append((low, max(low, low * GROW[0] // GROW[1])))
    return out


BANDS = bands()
_LARGEST = np.array([high for _, high in BANDS])


def instances(size: int) -> list[tuple[int, int, int]]:
    """(instance, k, N) of each instance that a set of this size takes part in."""
    own = int(np.searchsorted(_LARGEST, size))
    found = []
    for i in (own, own + 1):
        low, high = BANDS[i]
        if i == own or size * LEAST[1] >= low * LEAST[0]:
            k = 2 * high * (LEAST[1] - LEAST[0]) // sum(LEAST)
            found.append((i, k, k + 1 + (-(-(k + 1) // 10) if k else 0)))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str, shingle: int = SHINGLE, words: Words | None = None) -> np.ndarray:
    """Different 64-bit hashes of all shingles in ascending order; fewer words than a shingle are one, no words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return NONE
    known = Words() if words is None else words
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(shingle, len(found))
    n = len(found) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _ODD + h[i : i + n])
    return np.unique(out)


def among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending list."""
    if not len(listed):
        return np.zeros(len(x), bool)
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x


def signatures(found: np.ndarray, frequent: np.ndarray = NONE) -> np.ndarray:
    """Signatures of a set (ascending hashes, not empty)."""
    out, a = [], len(found)
    rare, contents = ~among(found, frequent), _mixed(found)
    for i, k, n in instances(a):
        salt = np.full(1, i, np.uint64) * _TWO
        part = _mixed(found + salt) % np.uint64(n)
        order = np.argsort(part.astype(np.uint16) if n < 1 << 16 else part, kind="stable")  # 16 bits are sorted in linear time
        sorted_parts = part[order]
        starts = np.flatnonzero(np.r_[True, sorted_parts[1:] != sorted_parts[:-1]])
        content = np.add.reduceat(contents[order], starts)
        telling = np.add.reduceat(rare[order].astype(np.int64), starts) > 0
        out.append(_mixed(content + sorted_parts[starts] * _ODD + salt)[telling])
        if int(telling.sum()) <= k:
            least = a - -(-LEAST[0] * a // LEAST[1]) + 1
            out.append(_mixed(np.r_[found[rare], found[~rare]][:least] ^ (salt + _ONE)))
    return np.concatenate(out)


def _longs(values: list[np.ndarray]) -> pa.Array:
    return near_copies.lists([v.tobytes() for v in values])


def _sampled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Different texts of one hash in SAMPLE."""
    text = documents(df, id_col, text_col).select("text")
    return text.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(SAMPLE)) == 0).distinct()


def _listed(values: DataFrame, least: int) -> np.ndarray:
    """The commonest of the column x with at least ``least`` rows, MOST at most, ascending."""
    top = values.groupBy("x").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "x").limit(MOST)
    return np.sort(np.array([r["x"] for r in top.select("x").collect()], np.int64).view(np.uint64))


def frequent_lists(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, and signatures that very many sets share, as the sample has them."""
    texts = _sampled(df, id_col, text_col)

    def made(frequent: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in batches:
                sets = [s for t in batch.column(0).to_pylist() if len(s := shingles(t, shingle, words))]
                values = sets if frequent is None else [signatures(s, frequent) for s in sets]
                yield pa.record_batch([pa.array(np.concatenate([NONE, *values]).view(np.int64))], ["x"])

        return texts.mapInArrow(run, "x long")

    frequent = _listed(made(None), FREQUENT)
    return frequent, _listed(made(frequent), SHARED)


def signed(df: DataFrame, frequent: np.ndarray, common: np.ndarray, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, n, plain, wide): a set's mark and size, and its signatures, those in common apart.

    A task gives the signatures of equal sets once while it remembers them.
    """
    prepare(df.sparkSession)
    docs = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            marks, sizes, plain, wide = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, shingle, words)
                mark = xxhash.xxh64_intdigest(found.tobytes())
                values = NONE
                if mark not in seen and len(found):
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    values = signatures(found, frequent)
                shared = among(values, common)
                marks.append(mark)
                sizes.append(len(found))
                plain.append(values[~shared])
                wide.append(values[shared])
            fp = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), fp, pa.array(sizes, pa.int64()), _longs(plain), _longs(wide)], ["doc_id", "text_hash", "fp", "n", "plain", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, n long, plain array<long>, wide array<long>")


class Groups:
    """Rows (value, fp) in ascending order, in batches, to pairs of small groups and members of large ones.

    A group of CROWD + 1 rows or more is passed on as it comes; no more than that is held.
    """

    def __init__(self, crowd: int):
        self.crowd = crowd
        self.value, self.fp = np.empty(0, np.int64), np.empty(0, np.int64)
        self.large: int | None = None

    def add(self, value: np.ndarray, fp: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crowded, a, b) of what the rows so far decide: pairs a < b, or b = a member of the crowded value a."""
        v, f = np.r_[self.value, value], np.r_[self.fp, fp]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (f[1:] != f[:-1])  # copies' signatures from several tasks
        v, f = v[new], f[new]
        end, begun = len(v), self.large
        if not last and end:
            end = int(np.searchsorted(v, v[-1]))
            if len(v) - end > self.crowd or v[-1] == self.large:
                self.large, end = int(v[-1]), len(v) - 1  # the last row stays, so that a copy of it is seen
        self.value, self.fp = v[end:], f[end:]
        v, f = v[:end], f[:end]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if end else np.empty(0, int)
        sizes = np.diff(np.r_[starts, end])
        size = np.repeat(sizes, sizes)
        crowded = size > self.crowd
        for large in (begun, self.large):
            if large is not None:
                crowded |= v == large
        a, b = [v[crowded]], [f[crowded]]
        for step in range(1, min(self.crowd, int(size.max(initial=1)))):
            at = np.flatnonzero((v[step:] == v[:-step]) & ~crowded[step:])
            if not len(at):
                break
            a.append(f[at])
            b.append(f[at + step])
        pairs = np.unique(np.stack([np.concatenate([a[0][:0], *a[1:]]), np.concatenate([b[0][:0], *b[1:]])]), axis=1)
        flags = np.r_[np.ones(len(a[0]), bool), np.zeros(pairs.shape[1], bool)]
        return flags, np.r_[a[0], pairs[0]], np.r_[b[0], pairs[1]]


def shared(index: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(crowded, a, b) of rows (value, fp): pairs a < b that share a value of ``crowd`` sets or fewer, or a value and one of its sets."""
    dealt = index.repartition("value").sortWithinPartitions("value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, none = Groups(crowd), np.empty(0, np.int64)
        packed = lambda found: pa.record_batch([pa.array(x) for x in found], ["crowded", "a", "b"])
        for batch in batches:
            yield packed(groups.add(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        yield packed(groups.add(none, none, last=True))

    return dealt.select("value", "fp").mapInArrow(run, "crowded boolean, a long, b long")


def links(df: DataFrame, rows: DataFrame, own: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b), a < b, between marks fp whose components are those of all similar sets.

    rows are those of signed and are deleted once their signatures have met; own has their columns doc_id, text_hash, fp, n.
    """
    met = stored(shared(rows.select("fp", F.explode("plain").alias("value")), crowd).distinct(), "part-enum-met")
    wide = stored(rows.select("fp", F.explode("wide").alias("value")).distinct(), "part-enum-wide")
    discard(rows)
    pairs = met.filter("not crowded").select("a", "b")
    crowded = met.filter("crowded").select(F.col("a").alias("value"), F.col("b").alias("fp")).union(wide.select("value", "fp"))
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).union(crowded.select("fp")).distinct()
    one = own.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("own"))
    one = stored(one.join(wanted, "fp", "left_semi").select("fp", "n", F.col("own.doc_id").alias("doc_id"), F.col("own.text_hash").alias("text_hash")), "part-enum-candidates")
    sets = stored(near_copies.sets_of(df, one, lambda text: shingles(text, shingle), id_col, text_col), "part-enum-sets")
    found = stored(near_copies.connecting(pairs, sets), "similar")
    if crowded.isEmpty():
        return found
    return near_copies.crowd_links(crowded, found, sets)


def classes(df: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of df, component_id the smallest doc_id reachable by links.

    Null, empty and wordless texts have an empty set, which is linked with nothing, not even its like; a text of fewer words than a
    shingle is one shingle. Equal sets are linked, repeated rows stay rows of their own. A row without doc_id keeps its
    row; component_id is null only where a whole component has no doc_id. Very long texts are hashed whole by the task that
    reads them. An empty table gives none; extra columns, whatever their names, are not looked at.
    """
    prepare(df.sparkSession)
    frequent, common = frequent_lists(df, shingle, id_col, text_col)
    rows = stored(signed(df, frequent, common, shingle, id_col, text_col), "part-enum-signatures")
    own = stored(rows.select("doc_id", "text_hash", "fp", "n"), "part-enum-rows")
    least = stored(own.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")), "part-enum-least")
    linked = components(links(df, rows, own, shingle, crowd, id_col, text_col)).withColumnRenamed("node", "fp")
    of_label = linked.join(least, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    moved = linked.join(of_label, "label").select("fp", "component_id")
    of_fp = least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    full = with_component(own.filter("n > 0"), of_fp, ("doc_id", "n", "fp"))
    empty = own.filter("n = 0").select("doc_id", "n", "fp", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
