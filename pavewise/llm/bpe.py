"""Byte-level BPE encoding and decoding from a public tokenizer file, by a contiguous rank array per word.

A word's bytes start as one part each. Two short lists hold the parts between the boundaries and the rank of every
boundary; the smallest rank is searched by a scan, its boundary deleted and the two neighbouring ranks refreshed, until
no boundary has a rank. For words of a few dozen bytes this scan beats any heap. Very long words (over LONG bytes) have their pair
ranks in a heap instead, with the same result, so that a megabyte without a space does not cost its square.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pavewise.llm import chunks
from pavewise.llm.common import documents, pick, prepare

#: The byte-level family's word pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
LONG = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Ids as the tokenizers library gives them for the file, and text from ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        #: two neighbouring parts' ids in one number -> rank; rank -> id of the merged part
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank_of[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.pieces = chunks.Cache(self._word, 100_000)
        self.cache = chunks.Cache(lambda chunk: self._words(" " + chunk), 350_000)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: parts side by side, each held by its id, and the rank of each boundary between two."""
        parts = [i for i in map(self.byte_id.__getitem__, word) if i >= 0]
        if len(parts) > LONG:
            return self._merge_long(parts)
        get, merged = self.rank_of.get, self.merged
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            part = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(part << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | part, NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, the ranks in a heap and the parts in a linked list."""
        n, get = len(parts), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int) -> int:
            return get(parts[i] << 32 | parts[after[i]], NONE) if after[i] < n else NONE

        now = [rank(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            gone = after[i]
            parts[i], after[i], now[gone] = self.merged[r], after[gone], NONE
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = rank(k)
                    if now[k] != NONE:
                        heapq.heappush(heap, (now[k], k))
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    def _word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes()

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.pieces.new.__getitem__, self.words.findall(text)))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.cache.turn()
        self.pieces.turn()
        if self.at_special and self.at_special.search(text):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.at_special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not chunks.safe(text):
            return self._words(text)
        first, *rest = text.split(" ")
        return self._words(first) + b"".join(map(self.cache.new.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are not UTF-8 become the replacement character, special tokens their content."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBPE:
    """One tokenizer per Python worker and file."""
    return ByteBPE(path)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens): little-endian 32-bit ids of every whole text.

    Null and empty texts give no ids; repeated rows give repeated results; an empty table gives an empty table; other
    columns are not looked at. No shuffle: each row is encoded where it is read.
    """
    prepare(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.packed(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(b) >> 2 for b in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    docs = documents(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from packed ids; null and empty ids give the empty text, repeated rows equal rows, an empty table none.

    Columns are found by exact spelling, whatever others the table has.
    """
    prepare(df.sparkSession)
    path = path or default_path()
    rows = pick(df, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them.

    Nulls count as empty texts; an empty text has no ids. Repeated rows give equal rows, an empty table none, and extra
    columns, whatever their names, are not looked at. A very long text is encoded whole by the task that reads it. Encoding
    and decoding share one pass, so no ids leave the worker.
    """
    prepare(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(path), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            packed = [bpe.packed(t) for t in batch.column(1).to_pylist()]
            back = [sha(bpe.decode(np.frombuffer(b, "<u4").tolist()).encode("utf-8", "surrogatepass")) for b in packed]
            yield pa.record_batch([batch.column(0), pa.array([len(b) >> 2 for b in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = documents(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
