"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy over the whole corpus, scores documents.

Words (lower case, by white space) are counted in a distributed table that grows with the corpus. The most frequent ones,
Shape.words of them, are the network's; each other word belongs to one of Shape.rare buckets by its last two bytes. A word
is predicted from ``side`` words on each of its sides, itself left out:

    hidden = tanh(bias + sum over places of gain[place] * embedding[word there])
    P(word) = P(class | hidden) * P(word | class, hidden)               for the network's words
    P(word) = P(bucket | hidden) * (n + 1) / (N + D + 1)                for all others: an explicit back-off

n counts the word, N and D the words and the different words of its bucket in the whole corpus, so the probabilities of the
seen words and of one unseen word for each bucket add up to 1. A document's score is the sum of log P over all its words.

Everything fitted comes from all documents: counts from every word; in each round the network predicts every word once.
Documents are dealt to shards by a hash of their own, shards hold about SHARD_WORDS words each and train one copy each in
an order of their own, and copies are averaged row by row in whole numbers, weighted by how often a shard used the row. So
nothing depends on partitions or batches, and neither a task nor the driver holds more than the parameters and KNOWN words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import discard, documents, prepare, stored

ROUNDS = 1
BATCH = 4096
RATE = 0.1
SHARD_WORDS = 1 << 21
#: Words whose counts every task holds (at most); counts of all others are joined in from the table.
KNOWN = 1 << 18
#: Words that a task holds before it counts them and passes the counts on.
HELD = 1 << 22
LARGEST = 64.0


@dataclass(frozen=True)
class Shape:
    width: int = 16
    classes: int = 32
    per: int = 128
    side: int = 2
    rare: int = 32

    @property
    def words(self) -> int:
        return self.classes * self.per

    @property
    def edge(self) -> int:
        """The id beyond a text's ends, after the words' and the buckets'."""
        return self.words + self.rare


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE_BYTE = re.compile(rb"[\t-\r ]")
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
PIECE = 1 << 20


def raw_text(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about PIECE bytes that cut no word."""
    at = 0
    while at < len(raw):
        gap = _SPACE_BYTE.search(raw, at + PIECE)
        end = gap.end() if gap else len(raw)
        yield at, end
        at = end


def hashed_words(raws: list[bytes], rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, bucket, sizes): 64-bit hashes and buckets of all words in order, and how many each text has.

    A word's hash is a mix of the sum of its bytes times powers of an odd constant; its bucket is one of its last two bytes.
    """
    joined, found = b" ".join(raws), []
    for a, b in _pieces(joined):
        raw = np.frombuffer(joined, np.uint8, b - a, a)
        word = np.flatnonzero(~_SPACE[raw])
        if not len(word):
            continue
        chars = raw[word].astype(np.uint64)
        first = np.flatnonzero(np.append(True, np.diff(word) > 1))
        size = np.diff(np.append(first, len(word)))
        place = (np.arange(len(word)) - np.repeat(first, size)) & 0xFFFF
        h = _mixed(np.add.reduceat((chars + np.uint64(1)) * _POWERS[place], first) + size.astype(np.uint64))
        last = first + size - 1
        end = chars[last] + np.uint64(256) * np.where(size > 1, chars[last - 1], np.uint64(0))
        found.append((h, (_mixed(end) % np.uint64(rare)).astype(np.int32), word[first] + a))
    starts = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    ends = np.cumsum([len(r) + 1 for r in raws])
    sizes = np.diff(np.searchsorted(starts, np.append(0, ends))) if raws else np.zeros(0, np.int64)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), sizes
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sizes


def word_counts(df: DataFrame, shape: Shape = Shape(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(h, bucket, n): how often each word occurs in all texts; written to the shared folder."""
    prepare(df.sparkSession)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, at, n = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.concatenate([x[1] for x in held])[at]), pa.array(n)], ["h", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            h, bucket, _ = hashed_words([raw_text(t) for t in batch.column(0).to_pylist()], shape.rare)
            held.append((h, bucket))
            size += len(h)
            if size > HELD:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    each = documents(df, id_col, text_col).select("text").mapInArrow(run, "h long, bucket int, n long")
    return stored(each.groupBy("h", "bucket").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Vocabulary:
    """Words that tasks know: sorted hashes with a code each. Codes below shape.words are the network's words by frequency.

    counts: n of each code; other_n, other_d: words and different words outside the network, by bucket; total: all words.
    """

    shape: Shape
    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    buckets: np.ndarray
    other_n: np.ndarray
    other_d: np.ndarray
    total: int

    @cached_property
    def back_off(self) -> np.ndarray:
        """log of a code's share in its bucket; 0 for the network's words."""
        out = np.log((self.counts + 1.0) / (self.other_n + self.other_d + 1.0)[self.buckets])
        out[: self.shape.words] = 0
        return out

    @cached_property
    def net_id(self) -> np.ndarray:
        """The network's id of each code, and of the codes after them: those of unknown words by bucket."""
        s = self.shape
        known = np.where(np.arange(len(self.counts)) < s.words, np.arange(len(self.counts)), s.words + self.buckets)
        return np.concatenate([known, s.words + np.arange(s.rare)]).astype("<u2")


def vocabulary(counts: DataFrame, shape: Shape = Shape(), known: int = KNOWN) -> Vocabulary:
    """The most frequent words: those above the least count that leaves at most ``known`` of them.

    That count is the edge of one of at most 4,096 ranges of counts, so the driver gets their totals and ``known`` rows.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).alias("step")
    ranges = sorted(map(tuple, counts.groupBy(step).agg(F.count("*"), F.min("n")).collect()), reverse=True)
    least, seen = 1 << 62, 0
    for _, k, n in ranges:
        seen += k
        if seen > known:
            break
        least = n
    got = counts.filter(F.col("n") >= least).select("h", "bucket", "n").toArrow()
    h, bucket, n = (got.column(c).to_numpy() for c in ("h", "bucket", "n"))
    order = np.lexsort((h, -n))
    h, bucket, n = h[order], bucket[order].astype(np.int64), n[order].astype(np.float64)
    pad = max(0, shape.words - len(h))  # places of the network without a word
    own = min(shape.words, len(h))
    other_n, other_d, total = np.zeros(shape.rare), np.zeros(shape.rare), 0
    for b, words, different in counts.groupBy("bucket").agg(F.sum("n"), F.count("*")).collect():
        other_n[b], other_d[b], total = words, different, total + words
    other_n -= np.bincount(bucket[:own], n[:own], shape.rare)
    other_d -= np.bincount(bucket[:own], minlength=shape.rare)
    at = np.argsort(h, kind="stable")
    # A hash with two buckets (a collision of two words) is known by its more frequent one.
    first = np.append(True, h[at][1:] != h[at][:-1]) if len(h) else np.zeros(0, bool)
    return Vocabulary(shape, h[at][first], at[first], np.concatenate([n, np.zeros(pad)]), np.concatenate([bucket, np.zeros(pad, np.int64)]), other_n, other_d, int(total))


class _Coder:
    """Codes of word hashes, by a table with open places; codes from len(counts) on are buckets of unknown words."""

    def __init__(self, v: Vocabulary):
        self.first, self.rare = len(v.counts), v.shape.rare
        self.net_id, self.back_off = v.net_id, np.concatenate([v.back_off, np.zeros(v.shape.rare)])
        self.keys, self.codes = v.hashes.view(np.uint64), v.codes
        self.bits = max(10, (4 * len(self.keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(self.keys)), 0
        while len(left):
            at = self._place(self.keys[left], step)
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, step = left[self.table[at] != left], step + 1

    def _place(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def of(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out, left, step = self.first + bucket.astype(np.int64), np.arange(len(h)), 0
        while len(left):
            key = self.table[self._place(h[left], step)]
            left, key = left[key >= 0], key[key >= 0]
            hit = self.keys[key] == h[left]
            out[left[hit]] = self.codes[key[hit]]
            left, step = left[~hit], step + 1
        return out

    def coded(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, pa.Array]:
        """Of each text: the network's ids, the known words' back-off, and the hashes of unknown words."""
        h, bucket, sizes = hashed_words([raw_text(t) for t in texts], self.rare)
        code, ends = self.of(h, bucket), np.append(0, np.cumsum(sizes))
        ids, doc = self.net_id[code], np.repeat(np.arange(len(texts)), sizes)
        unknown = code >= self.first
        tails = np.append(0, np.cumsum(np.bincount(doc[unknown], minlength=len(texts))))
        back = np.bincount(doc, self.back_off[code], len(texts))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], back, pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(h[unknown].view(np.int64)))


#: The last vocabulary's coder in this worker process, for the tasks to come.
_coder: dict[str, _Coder] = {}


def encoded(df: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, ids, back, tail) of each row, written to the shared folder.

    ids are the network's, 16 bits each; back is the sum of known words' back-off; tail has the hashes of unknown words.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    shared, name = spark.sparkContext.broadcast(v), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _coder:
            _coder.clear()
            _coder[name] = _Coder(shared.value)
        coder = _coder[name]
        for batch in batches:
            ids, back, tails = coder.coded(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(back, pa.float64()), tails], ["doc_id", "text_hash", "ids", "back", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, ids binary, back double, tail array<long>")
    return stored(rows, "word-ids")


@dataclass
class Net:
    """All parameters as rows of ``width`` numbers: embeddings (words, buckets, edge), gains, bias, weights of classes and
    buckets, weights of words by class, and the biases of both, in further rows."""

    shape: Shape
    rows: np.ndarray

    @staticmethod
    def fresh(v: Vocabulary, seed: int = 5) -> Net:
        """Unigram shares as biases, weights 0: before training every context predicts the unigram model."""
        s = v.shape
        net = Net(s, np.zeros((Net.starts(s)[-1], s.width), np.float32))
        words, gain, _, _, _, b1, b2 = net.parts
        words[:] = np.random.default_rng(seed).normal(0, 0.3, words.shape)
        gain[:] = 0.7
        n = np.maximum(v.counts[: s.words], 1e-4).reshape(s.classes, s.per)
        mass = np.concatenate([n.sum(1), np.maximum(v.other_n, 1e-4)])
        b1[:] = np.log(mass / mass.sum())
        b2[:] = np.log(n / n.sum(1, keepdims=True))
        return net

    @staticmethod
    def starts(s: Shape) -> list[int]:
        """First rows of the seven parts, and the number of rows."""
        sizes = [s.edge + 1, 2 * s.side, 1, s.classes + s.rare, s.words, -(-(s.classes + s.rare) // s.width), s.words // s.width]
        return [0, *np.cumsum(sizes).tolist()]

    @cached_property
    def parts(self) -> tuple[np.ndarray, ...]:
        """Views: embeddings, gains, bias, W1 (outcomes, width), W2 (classes, per, width), b1, b2 (classes, per)."""
        s, at = self.shape, Net.starts(self.shape)
        cut = [self.rows[a:b] for a, b in zip(at, at[1:], strict=False)]
        return cut[0], cut[1], cut[2][0], cut[3], cut[4].reshape(s.classes, s.per, s.width), cut[5].reshape(-1)[: s.classes + s.rare], cut[6].reshape(s.classes, s.per)

    def hidden(self, line: np.ndarray, spot: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        words, gain, bias, *_ = self.parts
        x = [words.take(line[spot + k], 0) for k in self.offsets]
        z = bias + x[0] * gain[0]
        for k in range(1, len(x)):
            z += x[k] * gain[k]
        return x, np.tanh(z)

    @property
    def offsets(self) -> list[int]:
        return [k for k in range(-self.shape.side, self.shape.side + 1) if k]

    def outcome(self, target: np.ndarray) -> np.ndarray:
        """Class of a word, or classes + bucket."""
        s = self.shape
        return np.where(target < s.words, target // s.per, target - s.words + s.classes)

    def by_class(self, line: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Places in the order of their outcomes, targets, outcomes, and (class, from, to) of the classes that occur."""
        out = self.outcome(line[spot])
        order = np.argsort(out.astype(np.int16), kind="stable")
        spot, out = spot[order], out[order]
        ends = np.searchsorted(out, np.arange(self.shape.classes + 1))
        return spot, line[spot], out, [(k, i, j) for k, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)) if i < j]

    def bound(self) -> None:
        """Keep weights and biases so small that no exp overflows: |hidden| <= 1, so a logit is at most LARGEST."""
        s, most = self.shape, LARGEST / 2
        for part in self.parts[3:5]:
            np.clip(part, -most / s.width, most / s.width, out=part)
        for part in self.parts[5:]:
            np.minimum(part, most, out=part)

    def log_probability(self, line: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, log P of the words there): the back-off of rare words is not in it."""
        _, _, _, w1, w2, b1, b2 = self.parts
        spot, target, out, runs = self.by_class(line, spot)
        h = self.hidden(line, spot)[1]
        logits = h @ w1.T
        logits += b1
        found = logits[np.arange(len(spot)), out]
        found -= np.log(np.exp(logits, out=logits).sum(1))
        within = target % self.shape.per
        for k, i, j in runs:
            inner = h[i:j] @ w2[k].T
            inner += b2[k]
            found[i:j] += inner[np.arange(j - i), within[i:j]]
            found[i:j] -= np.log(np.exp(inner, out=inner).sum(1))
        return spot, found

    def gradient(self, line: np.ndarray, spot: np.ndarray, grad: Net) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean -log P at spot: added into grad but for the embeddings, whose own is returned as (ids, rows)."""
        _, gain, _, w1, w2, b1, b2 = self.parts
        _, g_gain, g_bias, g_w1, g_w2, g_b1, g_b2 = grad.parts
        spot, target, out, runs = self.by_class(line, spot)
        n, (x, h) = len(spot), self.hidden(line, spot)
        every, within, one = np.arange(n), target % self.shape.per, h.dtype.type(1 / len(spot))
        ones = np.ones(max(len(w1), self.shape.per), h.dtype)

        def less_target(p: np.ndarray, at: np.ndarray) -> np.ndarray:
            np.exp(p, out=p)
            p *= (one / (p @ ones[: p.shape[1]]))[:, None]
            p[every[: len(p)], at] -= one
            return p

        p = h @ w1.T
        p += b1
        p = less_target(p, out)
        g_w1 += p.T @ h
        g_b1 += ones[:1].repeat(n) @ p
        dh = p @ w1
        for k, i, j in runs:
            hk = h[i:j]
            q = hk @ w2[k].T
            q += b2[k]
            q = less_target(q, within[i:j])
            g_w2[k] += q.T @ hk
            g_b2[k] += q.sum(0)
            dh[i:j] += q @ w2[k]
        h *= h
        dz = dh
        dz -= dh * h
        g_bias += dz.sum(0)
        for k in range(len(x)):
            g_gain[k] += np.einsum("ij,ij->j", x[k], dz)
        ids = np.concatenate([line[spot + k] for k in self.offsets])
        pulled = np.concatenate([dz * g for g in gain])
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return ids[first], np.add.reduceat(pulled[order], first, 0)


def laid_out(ids: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids in one array with edges around each; the words' places in it, and each one's document."""
    sizes = np.array([len(b) // 2 for b in ids], np.int64)
    words = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(words)) + shape.side * (doc + 1)
    line = np.full(len(words) + shape.side * (len(ids) + 1), shape.edge, np.int64)
    line[place] = words
    return line, place, doc


def train_copy(net: Net, docs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A copy's rows after one pass over all words of docs by Adagrad, and how often each row was used.

    Batches are cut by the words from the first document on, however the documents arrive.
    """
    s, at = net.shape, Net.starts(net.shape)
    net, grad = Net(s, net.rows.copy()), Net(s, np.zeros_like(net.rows))
    squares, used = np.full_like(net.rows, 1e-6), np.zeros(len(net.rows), np.int64)
    dense = slice(at[1], None)

    def learn(group: list[bytes]) -> None:
        line, place, _ = laid_out(group, s)
        for k in range(0, len(place), BATCH):
            spot = place[k : k + BATCH]
            grad.rows[dense] = 0
            ids, pulled = net.gradient(line, spot, grad)
            squares[ids] += pulled * pulled
            net.rows[ids] -= RATE * pulled / np.sqrt(squares[ids])
            g = grad.rows[dense]
            squares[dense] += g * g
            net.rows[dense] -= RATE * g / np.sqrt(squares[dense])
            net.bound()
            of = np.bincount(net.outcome(line[spot]), minlength=s.classes + s.rare)[: s.classes]
            for i in net.offsets:
                used[: at[1]] += np.bincount(line[spot + i], minlength=at[1])
            used[at[1] : at[4]] += len(spot)
            used[at[4] : at[5]] += np.repeat(of, s.per)
            used[at[5] : at[6]] += len(spot)
            used[at[6] :] += np.repeat(of, s.per // s.width)

    group, size = [], 0
    for ids in docs:
        group.append(ids)
        size += len(ids) // 2
        if size >= 16 * BATCH:
            learn(group)
            group, size = [], 0
    if size:
        learn(group)
    return net.rows, used


def shards(rows: DataFrame, total: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(shard, ids) of the different (doc_id, text_hash) of rows, and the number of shards, which follows the corpus.

    Repeated rows are one before the shuffle and teach once; a document's shard is a hash of its id and text.
    """
    n = max(1, -(-total // shard_words))
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash")
    one = rows.select("doc_id", "text_hash", "ids").dropDuplicates(["doc_id", "text_hash"])
    return stored(one.select(F.pmod(own, F.lit(n)).cast("int").alias("shard"), own.alias("place"), "ids"), "shard-ids"), n


def train(dealt: DataFrame, n: int, net: Net, total: int) -> Net:
    """One round over all documents: a copy for each shard, averaged row by row on the executors.

    Copies are summed as whole numbers, in units that keep the largest sum below 2 ** 62, so that no order of adding matters.
    """
    unit = 2.0 ** min(24, 62 - 7 - (2 * net.shape.side * max(total, 1)).bit_length())
    shape, shared = net.shape, dealt.sparkSession.sparkContext.broadcast(net.rows)
    names = [f"v{j}" for j in range(shape.width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        coming = rows()
        now = next(coming, None)
        while now is not None:
            shard = now[0]

            def of_shard() -> Iterator[bytes]:
                nonlocal now
                while now is not None and now[0] == shard:
                    yield now[1]
                    now = next(coming, None)

            out, used = train_copy(Net(shape, shared.value), of_shard())
            at = np.flatnonzero(used)
            for k in range(0, len(at), 4096):
                i = at[k : k + 4096]
                whole = np.rint(np.clip(out[i], -LARGEST, LARGEST).astype(np.float64) * used[i, None] * unit).astype(np.int64)
                yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(used[i]), *[pa.array(np.ascontiguousarray(whole[:, j])) for j in range(shape.width)]], ["row", "used", *names])

    copies = dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "place").select("shard", "ids").mapInArrow(run, "row int, used long, " + ", ".join(f"{c} long" for c in names))
    sums = copies.groupBy("row").agg(F.sum("used").alias("used"), *[F.sum(c).alias(c) for c in names]).toArrow()
    rows = net.rows.copy()
    if sums.num_rows:
        at, used = sums.column("row").to_numpy(), sums.column("used").to_numpy().astype(np.float64)
        rows[at] = np.stack([sums.column(c).to_numpy() for c in names], 1) / (used * unit)[:, None]
    return Net(shape, rows)


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: DataFrame
    net: Net


def fit(df: DataFrame, rounds: int = ROUNDS, shape: Shape = Shape(), known: int = KNOWN, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all of df's documents, and df's encoded rows."""
    counts = word_counts(df, shape, text_col, id_col)
    v = vocabulary(counts, shape, known)
    rows, net = encoded(df, v, id_col, text_col), Net.fresh(v)
    dealt, n = shards(rows, v.total, shard_words)
    for _ in range(rounds):
        net = train(dealt, n, net, v.total)
    discard(dealt)
    return Model(v, counts, net), rows


def _tails(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_hash, tail): the summed back-off of words that tasks don't know, by a join with all counts.

    Such a word's count is under the least of the known ones, so none is hot.
    """
    v = model.vocabulary
    one = rows.filter(F.size("tail") > 0).select("doc_id", "text_hash", "tail").dropDuplicates(["doc_id", "text_hash"])
    each = one.select("doc_id", "text_hash", F.explode("tail").alias("h"))
    room = F.lit((v.other_n + v.other_d + 1.0).tolist()).cast("array<double>")
    spread = model.counts.select("h", (F.log(F.col("n") + 1.0) - F.log(F.get(room, F.col("bucket")))).alias("share")).groupBy("h").agg(F.max("share").alias("share"))
    new = -float(np.log(np.mean(v.other_n + v.other_d + 1.0)))  # a word that the counts lack
    return each.join(spread, "h", "left").groupBy("doc_id", "text_hash").agg(F.sum(F.coalesce("share", F.lit(new))).alias("more"))


def score(df: DataFrame, rounds: int = ROUNDS, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of every document, under a model of df itself unless one is given.

    Null, empty and wordless texts have n_tokens 0, log_likelihood 0 and per_token null; a lone word is predicted from
    the edges. Repeated rows score alike, and rows that are equal in id and text teach once. Very long texts are one row
    of 16-bit ids. Extra columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    own = model is None
    if own:
        model, rows = fit(df, rounds, id_col=id_col, text_col=text_col, **settings)
    else:
        rows = encoded(df, model.vocabulary, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model.net.rows)
    shape = model.net.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(shape, shared.value)
        for batch in batches:
            line, place, doc = laid_out(batch.column(2).to_pylist(), shape)
            of = np.zeros(len(line), np.int64)
            of[place] = doc
            total = batch.column(3).to_numpy(zero_copy_only=False).copy()
            for at in range(0, len(place), 1 << 14):
                spot, found = net.log_probability(line, place[at : at + (1 << 14)])
                total += np.bincount(of[spot], found, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.bincount(doc, minlength=batch.num_rows)), pa.array(total)], ["doc_id", "text_hash", "n_tokens", "part"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "text_hash", "ids", "back").mapInArrow(run, f"doc_id {kind}, text_hash long, n_tokens long, part double")
    tails = stored(_tails(rows, model).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more"), "word-tails")
    if own:
        discard(model.counts)  # the tails were the last to read them
    every = scored.join(tails, scored["doc_id"].eqNullSafe(tails["_id"]) & (scored["text_hash"] == tails["_hash"]), "left")
    total: Column = F.col("part") + F.coalesce("more", F.lit(0.0))
    return every.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))
