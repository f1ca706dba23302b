"""A store of token ids: blocks of concatenated ids, with Elias-Fano coded document ids and boundaries.

Layout of a store (a folder that Spark writes with its own commit protocol, so a lost executor's block is written again
and never twice):

``blocks/``    Parquet rows (shard, block, base, n_docs, n_tokens, n_null, width, doc_ids, bounds, ids). A shard is one
               range of document ids in ascending order, its blocks follow each other; ``ids`` are little-endian unsigned
               integers of ``width`` bytes, ``bounds`` the Elias-Fano coded starts of the block's documents in it (and its
               end), ``doc_ids`` the Elias-Fano coded ids, ``base`` the ids before the block in its shard.
``shards/``    (shard, base, n_docs, n_tokens): the ids before each shard. One narrow row for each shard.

A document's place is shards.base + blocks.base + bounds.select(k): no 64-bit offset is kept for any document.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pavewise.llm import chunks
from pavewise.llm.bpe import PATTERN, byte_alphabet, default_path
from pavewise.llm.common import documents, partitions, prepare
from pavewise.llm.elias_fano import EliasFano

#: A block is closed when it holds this many ids; one document is never split.
BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, base long, n_docs int, n_tokens long, n_null int, width int, doc_ids binary, bounds binary, ids binary"
SHARDS = "shard int, base long, n_docs long, n_tokens long"


def _gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which``, one after the other, and their sizes; entry k is the k-th of the runs of ``sizes`` ids in ids."""
    n = sizes[which]
    first = (np.cumsum(sizes) - sizes)[which]
    return ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _joined(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(entries), "<u4"), np.fromiter(map(len, entries), np.int64, len(entries)) >> 2


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class _Encoder:
    """The tokenizers library behind a cache of words; texts whose words can't be cut apart go to it whole.

    The different chunks of a batch, found by Arrow, go through the pattern once, and the library's model gets each word that the
    cache lacks once; ids are put together from there by numpy.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merged = self.library.model.tokenize
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = regex.compile(PATTERN)
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.pieces = chunks.Cache(self._word, 600_000)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern, by the library's model on the characters that stand for its bytes."""
        plain = word.replace(" ", self.alphabet[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.merged(plain)]).tobytes()

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.pieces.new.__getitem__, self.words.findall(text)))

    def _chunks(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks, each behind a space; none is empty or has white space at an end, so that space begins a word."""
        found = pa.array(self.words.findall(" " + " ".join(some)) if some else [], pa.string()).dictionary_encode()
        ids, sizes = _joined(list(map(self.pieces.new.__getitem__, _strings(found.dictionary))))
        which = found.indices.to_numpy()
        ids, sizes = _gathered(ids, sizes, which)
        starts = np.flatnonzero(pc.starts_with(found.dictionary, " ").to_numpy(zero_copy_only=False)[which]) if some else which
        return ids, np.add.reduceat(sizes, starts) if some else sizes

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        self.pieces.turn()
        whole = {k: self._whole(t) for k, t in enumerate(texts) if any(s in t for s in self.special) or not chunks.safe(t)}
        cut = pc.split_pattern(pa.array(["" if k in whole else t for k, t in enumerate(texts)], pa.string()), " ")
        first = cut.offsets.to_numpy()[:-1]
        coded = cut.values.dictionary_encode()
        different, code = _strings(coded.dictionary), coded.indices.to_numpy()
        plain = np.array([c != "" and c == c.strip() for c in different], bool)
        ids, sizes = self._chunks([c for c, p in zip(different, plain, strict=True) if p])
        # Behind the plain chunks: those that must go through the pattern alone, and each text's first, which has no space before it.
        apart = [self._words(" " + c) for c, p in zip(different, plain, strict=True) if not p]
        apart += [whole[k] if k in whole else self._words(different[code[i]]) for k, i in enumerate(first)]
        more, more_sizes = _joined(apart)
        place = np.where(plain, np.cumsum(plain) - 1, len(sizes) + np.cumsum(~plain) - 1)[code]
        place[first] = len(sizes) + len(apart) - len(texts) + np.arange(len(texts))
        ids, sizes = _gathered(np.concatenate([ids, more]), np.concatenate([sizes, more_sizes]), place)
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)[np.r_[first[1:], len(place)] - 1]
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _block(shard: int, block: int, base: int, ids: list[int | None], packed: list[bytes], width: int) -> dict:
    known = [i for i in ids if i is not None]
    sizes = [len(b) >> 2 for b in packed]
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
    raw = b"".join(packed)
    if width == 2:
        raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes()
    return {"shard": shard, "block": block, "base": base, "n_docs": len(ids), "n_tokens": sum(sizes), "n_null": len(ids) - len(known), "width": width, "doc_ids": EliasFano.of(known).to_bytes(), "bounds": bounds.to_bytes(), "ids": raw}


def write(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text with the tokenizers library, append end_id, store in ascending id order.

    Null text is the empty text (its ids are the end id alone). Null document ids come first. Rows that repeat an id stay
    apart, next to each other. An empty table gives a store without blocks. Ids must be integers. A very long text is encoded
    whole, in chunks, by one task, and stands in a block of its own size; extra columns, whatever their names, are not looked at.
    The one shuffle is the range partitioning by id; ties are spread by the text's hash, so a hot id is not one task's.
    """
    spark = df.sparkSession
    prepare(spark)
    tokenizer = tokenizer or default_path()
    docs = documents(df, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), _encoder(tokenizer), end_id.to_bytes(4, "little")
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("n_null", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary())])
        base, block, ids, packed, size = 0, 0, [], [], 0
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                ids.append(i)
                packed.append(b + end)
                size += len(b) // 4 + 1
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, base, ids, packed, width)], schema)
                    base, block, ids, packed, size = base + size, block + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(shard, block, base, ids, packed, width)], schema)

    ranged.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_docs", "n_tokens").coalesce(1).write.parquet(f"{path}/shards")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their global base. The shard table has a narrow row for each written range, so it is broadcast."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").select("shard", F.col("base").alias("shard_base"))
    return blocks.join(F.broadcast(shards), "shard").select((F.col("shard_base") + F.col("base")).alias("base"), "n_null", "width", "doc_ids", "bounds", "ids")


def _opened(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    ids = [None] * row["n_null"] + EliasFano.from_bytes(row["doc_ids"]).all().tolist()
    return ids, EliasFano.from_bytes(row["bounds"]).all(), np.frombuffer(row["ids"], f"<u{row['width']}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document of a store."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, bounds, ids = _opened(row)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), lists], ["doc_id", "start", "n_tokens", "ids"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the store's files."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, bounds, ids = _opened(row)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens) of the named documents by select alone; ids that the store lacks give no row.

    doc_ids is the caller's own short list; blocks whose id range misses it are skipped after reading two values.
    """
    prepare(spark)
    wanted = np.unique(np.asarray(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, bounds, out = EliasFano.from_bytes(row["doc_ids"]), EliasFano.from_bytes(row["bounds"]), []
                if not ids.n:
                    continue
                for want in wanted[(wanted >= ids.select(0)) & (wanted <= ids.select(ids.n - 1))].tolist():
                    low, high = 0, ids.n
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (mid + 1, high) if ids.select(mid) < want else (low, mid)
                    while low < ids.n and ids.select(low) == want:
                        a, b = bounds.select(row["n_null"] + low), bounds.select(row["n_null"] + low + 1)
                        out.append((want, row["base"] + a, b - a))
                        low += 1
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens"])

    return _placed(spark, path).drop("ids", "width").mapInArrow(run, "doc_id long, start long, n_tokens long")
