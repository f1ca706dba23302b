"""Operators 3, 4, 7, 8 and 10."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pavewise.llm import licenses, secret_scan, spotsigs, toxicity
from pyspark.sql import functions as F


def plain_signatures(text):
    """Anchors found one by one, each with the next two content words after it."""
    words = [w for w in (t.strip(spotsigs.EDGE) for t in text.lower().split()) if w]
    out = set()
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[k + 1 :] if x not in spotsigs.COMMON][:2]
            if len(chain) == 2:
                out.add(zlib.crc32(" ".join([w, *chain]).encode()))
    if not out:
        pairs = [words[k : k + 2] for k in range(max(1, len(words) - 1))] if words else []
        out = {zlib.crc32(" ".join(p).encode()) for p in pairs} or {zlib.crc32(text.encode())}
    return out


def test_signatures_by_hand(texts):
    rng = random.Random(2)
    common = [*sorted(spotsigs.COMMON)[:40], *sorted(spotsigs.ANCHORS)[:40], "house", "Boat,", "«river»", "42"]
    for text in [*(t for _, t in texts if len(t) < 2000), *(" ".join(rng.choices(common, k=60)) for _ in range(40))]:
        assert spotsigs.signatures(text) == plain_signatures(text)


def test_one_id_of_most_rows_is_dealt_to_several_parts(spark):
    """Nine tenths of all rows have no id: they go to several parts by text hash, and each row still meets its next one."""
    from pavewise.llm.ordered import with_next

    rows = [(None, f"text {i}") for i in range(900)] + [(i, f"other {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    dealt = with_next(df, 10).filter("not guest").groupBy("part").count().collect()
    assert len(dealt) > 6 and max(r["count"] for r in dealt) < 300
    got = spotsigs.compare_with_next(df).collect()
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        new = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]
        want[(i, hashlib.sha256(new.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_spotsigs_query(odd, none, texts):
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in spotsigs.compare_with_next(odd).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    for k, ((_, t), r) in enumerate(zip(rows, got, strict=True)):
        other = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        a, b, c = map(spotsigs.signatures, (t, new, other))
        assert r[1:5] == (len(t), hashlib.sha256(new.encode()).hexdigest(), spotsigs.text_form(a), spotsigs.text_form(b))
        assert (r[5], r[6]) == (len(a & b) / len(a | b), len(a & c) / len(a | c))
    assert spotsigs.compare_with_next(none).count() == 0
    lone = spotsigs.compare_with_next(odd.filter("doc_id = 4")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_spotsigs_pruning():
    a, b = frozenset(range(10)), frozenset(range(5, 40))
    assert spotsigs.jaccard(a, b) == 5 / 40
    assert spotsigs.jaccard(a, b, 0.8) == 0.0
    assert spotsigs.jaccard(frozenset(), frozenset()) == 1.0


def test_spotsigs_near_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and", "a"] * 40
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 60))) for _ in range(40)]
    for k in range(15):
        w = docs[k].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    docs += docs[:5]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    cls = dict(members.collect())
    got = {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()}
    sets = {cls[i]: spotsigs.signatures(t) for i, t in enumerate(docs)}
    keys = list(sets)
    want = {tuple(sorted((x, y))) for i, x in enumerate(keys) for y in keys[i + 1 :] if spotsigs.jaccard(sets[x], sets[y]) >= 0.8}
    assert got == want and want


def test_licenses(spark, odd, none):
    filler = [f"word{i}" for i in range(400)]
    long = licenses.TEMPLATES["mit-grant"].split()
    docs = [
        (1, " ".join(filler[:37]) + "\nReleased under the MIT License.\n" + " ".join(filler[37:])),
        (2, " ".join(filler[:90] + long + filler[90:])),
        (3, " ".join(filler[:11] + long[:30] + ["other"] + long[31:] + filler[11:])),
        (4, " ".join(long[: len(long) // 3])),
        (5, "the MIT License was released under"),
        (6, None),
    ]
    got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit-notice"), (2, "mit-grant"), (3, "mit-grant")}
    assert got[(1, "mit-notice")] == got[(2, "mit-grant")] == 1.0 and 0.8 <= got[(3, "mit-grant")] < 1
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_license_recall_against_exact_containment(spark):
    """Every template with words changed at random: what exact containment in the best window finds, the bands find."""
    rng, docs = random.Random(12), []
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        for share in (0.0, 0.02, 0.04):
            w = licenses._words(text)
            for at in rng.sample(range(len(w)), round(len(w) * share)):
                w[at] = f"x{rng.randrange(99)}"
            pad = [f"f{k}x{rng.randrange(999)}" for _ in range(rng.randrange(200))]
            docs.append((len(docs), " ".join([*pad, *w, *pad[:50]]), name))
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string, name string")).collect()}
    want = set()
    for i, text, _ in docs:
        own = set(licenses.shingles(text))
        want |= {(i, n) for n, t in licenses.TEMPLATES.items() if len(own & set(licenses.shingles(t))) >= 0.8 * len(set(licenses.shingles(t)))}
    assert got == want and len(want) > 50


def test_the_least_likeness_is_reached_at_80_percent():
    assert licenses.likeness(30, 75, 0.8) == 24 / 81 and licenses.likeness(4, 4, 1.0) == 1


def test_band_count_keeps_its_promise():
    for least in (0.1, 0.3, 0.8):
        b = licenses.bands_for(least)
        assert 1 - (1 - least) ** b >= licenses.SURE > 1 - (1 - least) ** (b - 1)


def spans(text):
    found = [("assign", 0, m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 6]
    found += [("access", 1, m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", 2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{e}" for k, _, a, e in sorted(found, key=lambda s: (s[2], s[1])))


def test_secrets(spark, odd, none, texts):
    rng = random.Random(9)
    parts = ["password", "PASSWD", "api_key", "apikey", "ApiKey", "token", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "cafe", "é", "😀", "\n", "-", "zzz"]
    docs = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.summary(secret_scan.scan_documents(rows)).collect())
    assert got == Counter((i, hashlib.sha256(spans(t).encode()).hexdigest()) for i, t in [*docs, *texts])
    odd_rows = secret_scan.summary(secret_scan.scan_documents(odd)).collect()
    assert len(odd_rows) == len(texts) and {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in odd_rows}[12] == (2, 1, 1)
    assert secret_scan.scan_documents(none).count() == 0


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token=abcdef1"), (2, "clean"), (3, "clean")], "doc_id long, text string")
    secret_scan.scan(first, ledger, secret_scan.BASE)
    assert spark.read.parquet(ledger).count() == 2
    second = first.union(spark.createDataFrame([(4, "token=abcdef1"), (5, "ghp_" + "zQ" * 20)], "doc_id long, text string"))
    secret_scan.scan(second, ledger, secret_scan.BASE)
    assert spark.read.parquet(ledger).count() == 3
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.scan_documents(second, ledger).collect()}
    assert found == {1: ["assign"], 2: [], 3: [], 4: ["assign"], 5: ["forge_token"]}
    assert spark.read.parquet(ledger).count() == 6  # the added rules' pairs alone
    secret_scan.scan(second, ledger)
    assert spark.read.parquet(ledger).count() == 6


def test_redaction(odd, texts):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == len(texts)
    t = out.filter("doc_id = 12").select(F.col(out.columns[0]), out[out.columns[4]].alias("n")).collect()[0]
    flat = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).filter("c0 = 12").collect()[0]
    assert flat["c1"] == '[secret]" token:abc [secret] [secret] [secret]' and t["n"] == len(flat["c1"])


def test_toxicity_learns(spark, odd, none):
    rng = random.Random(5)
    calm = [f"wort{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.choices(calm, k=40)
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(40), rng.choice(["idiot", "moron"]) if i % 8 else "grumpel" + rng.choice(["ung", "er", "isch"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 60 and np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.scores(odd, model).count() == odd.count() and toxicity.scores(none, model).count() == 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and 400 <= kept.count() <= 470
    alone = toxicity.fit(docs, lab.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.scores(docs, alone).collect()} == {0}
    assert toxicity.scores(odd, toxicity.fit(odd, lab.filter("false"))).count() == odd.count()


def test_isotonic_never_falls():
    s = np.array([0.1, 0.2, 0.2, 0.5, 0.6, 0.9])
    x, p = toxicity.isotonic(s, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()


def test_a_newer_rule_version_replaces_what_the_older_found(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "x " + "ab12" * 8 + " AKIA" + "Z9" * 9)], "doc_id long, text string")
    wide = (secret_scan.Rule("hex", 1, r"[0-9a-f]{8,}", 0, 8), secret_scan.BASE[1])
    narrow = (secret_scan.Rule("hex", 2, r"[0-9a-f]{40,}", 0, 40), secret_scan.BASE[1])
    first = secret_scan.scan_documents(df, ledger, wide).first()["spans"]
    assert [s["kind"] for s in first] == ["hex", "access"]
    second = secret_scan.scan_documents(df, ledger, narrow).first()["spans"]
    assert [s["kind"] for s in second] == ["access"]
    assert [s["kind"] for s in secret_scan.scan_documents(df, ledger, wide).first()["spans"]] == ["hex", "access"]
