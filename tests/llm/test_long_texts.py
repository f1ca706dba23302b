"""No text may stop a run: long runs without white space, and very many hits in one text."""

import hashlib
import re
import time

import pytest
from pavewise.llm import secret_scan, toxicity

SECRET = "token=abcdef1 x "
TEXTS = {
    "letters": "a" * 1_000_000 + "1",
    "heads": "eyJ" * 333_000,
    "heads with dots": "eyJabcdefgh." * 80_000 + "é" + "eyJa.b" * 100_000,
    "secrets": "é😀 " + SECRET * 50_000,
    "one secret": "password=" + "x" * 1_000_000,
    "spaces": ("password" + " " * 2000) * 400,
    "hex": ("deadbeef" * 3 + " ") * 30_000 + "abc" * 50_000,
}


def plain(text, rules):
    """(kind, start, end) of the rules' counting matches, by start and rule."""
    found = [(m.start(), i, m.end(), r.kind) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least]
    return [(k, a, e) for a, _, e, k in sorted(found)]


def redacted(text, spans):
    out, at = [], 0
    for _, a, e in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("text", ["x" * 1_000_000 + "1!", "a!" * 500_000, "aaabbb" * 160_000, "idiot you " * 100_000, "!" * 1_000_000, "a" + "!" * 1_000_000])
def test_toxicity_features(text):
    began = time.process_time()
    assert len(toxicity.features(text, toxicity.Lexicon())) == len(toxicity.FEATURES)
    assert time.process_time() - began < 6


def test_masked_words_are_the_plain_patterns():
    plain_form = re.compile(r"[a-z]+[@$!*#+013457]+[a-z]+(?:[@$!*#+013457]+[a-z]+)*")
    for text in ("id!ot", "a!b!!c d", "!!a!", "aa1", "1a1a", "éa!bé", "a!b1", "x" * 50 + "!" * 50 + "y"):
        assert toxicity.MASKED.findall(text) == plain_form.findall(text)


def test_secret_spans_and_redaction(spark):
    rows = list(enumerate(TEXTS.values()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.range(3).count()
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.summary(secret_scan.scan_documents(df)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    took = time.time() - began
    for i, text in rows:
        want = plain(text, secret_scan.RULES)
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{e}" for k, a, e in want)
        base = [s for s in want if s[0] in ("assign", "access", "hex")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in base).encode()).hexdigest()
        assert clean[i] == redacted(text, want)
    assert got[3]["n_assign"] == 50_000 and took < 60


def test_redaction_at_every_place(spark):
    """Secrets that begin and end at, before and behind the borders of chunks."""
    texts = ["é" * n + " token=abcdefg" + "😀" * m for n in (0, 1, 495, 496, 497, 498, 499, 510, 511, 512, 513, 1023, 1024) for m in (0, 1, 511, 512, 1100)]
    out = secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: redacted(t, plain(t, secret_scan.RULES)) for i, t in enumerate(texts)}
