"""Operators 1 and 5 against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pavewise.llm import bpe, token_store
from pavewise.llm.elias_fano import EliasFano


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_bpe_equals_library(library):
    own, rng = bpe.load(bpe.default_path()), random.Random(4)
    parts = ["a", "th", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "日本", "'s", "'LL", "12", " \n", "\x85", " ", "\xa0", "$$", "...", "ABC", "́", "½", "ththth", "😀", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = ids_of(library, text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for text in ("a" * 3000, "xyzzy" * 900, "".join(rng.choice("etaoin") for _ in range(4000))):
        assert own.encode(text) == ids_of(library, text)


def test_bpe_decodes_broken_bytes(library):
    own = bpe.load(bpe.default_path())
    for ids in ([169], [447, 12], [50256, 169, 220]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_query(odd, none, texts, library):
    got = Counter(tuple(r) for r in bpe.round_trip(odd).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in texts:
        ids = ids_of(library, t)
        want[(i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert got == want
    assert bpe.round_trip(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd.filter("doc_id = 9"))).collect()}
    assert back == {9: dict(texts)[9]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700))
def test_elias_fano(values):
    values.sort()
    code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert code.all().tolist() == values
    for k in range(0, len(values), 37):
        assert code.select(k) == values[k]


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(200, 2000, 5000))
    assert len(EliasFano.of(bounds).to_bytes()) < 5000 * 2


def test_store(spark, odd, none, texts, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 3000)
    path = str(tmp_path / "store")
    token_store.write(odd, path)
    got = sorted((tuple(r) for r in token_store.digests(spark, path).collect()), key=lambda r: r[1])
    ids = {i: [*ids_of(library, t), 2] for i, t in texts}
    assert [r[0] for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    start = 0
    for doc, at, n, crc in got:
        assert (at, n, crc) == (start, len(ids[doc]), zlib.crc32(struct.pack(f"<{n}I", *ids[doc])))
        start += n
    assert {r["doc_id"]: r["ids"] for r in token_store.read(spark, path).collect()} == ids
    found = token_store.lookup(spark, path, [6, 9, 777]).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in found) == sorted(r[:3] for r in got if r[0] in (6, 9))
    token_store.write(none, str(tmp_path / "empty"))
    assert token_store.digests(spark, str(tmp_path / "empty")).count() == 0


def test_encoder_runs_the_pattern_once_a_batch(library):
    """Not once for each different chunk; texts of all kinds still get the library's ids, batch after batch."""
    class Counted:
        def __init__(self, words):
            self.words, self.calls = words, 0

        def findall(self, text):
            self.calls += 1
            return self.words.findall(text)

    rng, encoder = random.Random(12), token_store._Encoder(bpe.default_path())
    encoder.words = Counted(encoder.words)
    texts = [" ".join(f"w{rng.randrange(10**6)}.{'é' * (k % 3)}" for _ in range(50)) for k in range(200)]
    for some in (texts, texts[:7], ["x" * 200 + " y", texts[0]]):
        encoder.words.calls = 0
        assert encoder.batch(some) == [struct.pack(f"<{len(i)}I", *i) for i in (ids_of(library, t) for t in some)]
        assert encoder.words.calls <= len(some) + 1
    parts = ["a", "th", " ", "  ", "\n", "\t", " \n", "\n ", "<|endoftext|>", "é", "日本", "'s", "12", "\x85", "\xa0", "　", "$$", "😀", "\x1c", "\x00", "z" * 70]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for some in (odd, [""], ["", " ", "\n", "a", "  "], []):
        assert encoder.batch(some) == [struct.pack(f"<{len(i)}I", *i) for i in (ids_of(library, t) for t in some)]
