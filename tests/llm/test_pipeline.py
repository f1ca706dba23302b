"""The pipeline's stages against brute force, each on its own input, and run() as a whole."""

import hashlib
import os
import re
import struct
from collections import Counter

import corpus_pipeline as P
import pytest
from pavewise.llm import bpe, mixing, secret_scan, toxicity
from pavewise.llm.common import table

from tests.llm.test_near_copies import kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each, as dicts, by the stages' own writing and reading."""
    docs, out = table(spark, SF, "documents"), []
    columns = docs.columns
    out.append([r.asDict() for r in docs.collect()])
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "mixing", "bpe"]


def test_toxicity_stage(spark, steps):
    docs = table(spark, SF, "documents")
    bad = {r["doc_id"] for r in toxicity.scores(docs, toxicity.fit(docs, table(spark, SF, "labels"))).collect() if r["score"] >= 0.5}
    assert sorted(r["doc_id"] for r in steps[1]) == sorted(r["doc_id"] for r in steps[0] if r["doc_id"] not in bad)


def test_dedup_stage(steps):
    rows = [(r["doc_id"], re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or "")) for r in steps[1]]
    want = kept(rows)
    assert sorted(r["doc_id"] for r in steps[2]) == want and len(want) < len(rows)


def redact(text):
    spans = []
    for rule in secret_scan.RULES:
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), m.end()))
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_secret_stage(steps):
    want = {r["doc_id"]: redact(r["text"]) for r in steps[2]}
    assert {r["doc_id"]: r["text"] for r in steps[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3] if "[secret]" in r["text"])


def test_mixing_stage(steps):
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    before = Counter()
    for r in steps[3]:
        before[r["source"]] += size(r["text"])
    after, times = Counter(), Counter(r["doc_id"] for r in steps[4])
    for r in steps[4]:
        after[r["source"]] += size(r["text"])
    names = sorted(before)
    largest = max(size(r["text"]) for r in steps[3])
    for s, t in zip(names, mixing.targets([before[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        assert abs(after[s] - t) <= largest
    assert max(times.values()) == 2


def test_bpe_stage_and_run(spark, steps):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(bpe.default_path()), Counter()
    for r in steps[4]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in steps[5]) == want
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, SF).collect()) == want


def test_odd_rows_go_through_all_stages(spark, odd, none):
    """Nulls, empty and very long texts, repeats, and extra columns whose names clash; an empty table."""
    out = P.through(spark, odd, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in odd.select("doc_id").collect()}
    assert P.through(spark, none, SF).count() == 0
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns and stage(spark, none, SF).count() == 0, name
    labelled = table(spark, SF, "labels").filter("false")
    assert toxicity.reject(odd, toxicity.fit(odd, labelled)).count() == odd.count()
