"""Near copies of the pipeline's stage against brute force."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline as P
import pytest
import xxhash
from pavewise.llm import near_copies, simhash
from pavewise.llm.graph import components
from pyspark.sql import functions as F


def plain_set(text, k=5):
    words = (text or "").split()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """The smallest id of each component of all pairs at 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return sorted({top(i) for i in root})


def changed(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Texts of 60 to 300 words and copies of them with words changed, most at similarities of 0.7 to 0.95."""
    rng, rows = random.Random(seed), []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        rows.append(" ".join(words))
        rows += [" ".join(changed(rng, words, max(1, round(len(words) * share)))) for share in (0.006, 0.012, 0.018, 0.022, 0.03)]
    rows += [None, "", " \n", "one two", "One  two", "alone"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_finds_pairs_from_0_8_on(spark):
    rows = corpus(4)
    low = [(i, t and t.lower()) for i, t in rows]
    levels = Counter(round(jaccard(plain_set(a), plain_set(b)), 1) for (_, a), (_, b) in combinations(low, 2) if a and b and jaccard(plain_set(a), plain_set(b)) > 0.65)
    assert min(levels[0.7], levels[0.8], levels[0.9]) > 20
    out = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in out.collect()) == kept(low)


@pytest.mark.parametrize("crowd", [3, 30])
def test_crowded_fingerprints(spark, crowd):
    """Chains through one template: many sets share a fingerprint, and not all are similar to the ones met first."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = list(enumerate(" ".join(changed(rng, words, rng.choice((1, 2, 3, 5)))) for _ in range(120)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.classes(df, crowd=crowd).collect()
    assert sorted({r["component_id"] for r in found}) == kept(rows) and len(found) == len(rows)


def test_nine_tenths_equal_texts_and_a_star(spark):
    """One text that most rows hold, and a centre near to all of its copies, which are not near to each other."""
    rng = random.Random(3)
    centre = [f"c{k}" for k in range(100)]
    rays = [" ".join(changed(rng, centre, 2)) for _ in range(30)]
    texts = ["the same words again and again in most of all rows"] * 600 + [" ".join(centre), *rays]
    rows = list(enumerate(texts))
    found = near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string"), crowd=5).collect()
    assert sorted({r["component_id"] for r in found}) == kept(rows) == [0, 600] and len(found) == len(rows)


def test_equal_rows_leave_one_that_order_does_not_change(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (1, "a b", "y"), (None, "c", None), (None, "c", "z")], "doc_id long, text string, more string")
    one, two = (sorted(map(str, near_copies.keep_one(d).collect())) for d in (df, df.orderBy("more").repartition(3)))
    assert one == two and len(one) == 2


def test_odd_rows(odd, none):
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns and sorted(r[0] for r in out.collect() if r[0]) == sorted({1, 4, 5, 7, 8, 9, 10, 12, 50})
    assert near_copies.keep_one(none).count() == 0


def plain_mark(shingles):
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_without_other_fingerprints(spark):
    """All pairs of different sets within 4 bits of SimHash and at 0.8 or more, and no others, when no set has min-wise fingerprints."""
    rng, texts = random.Random(7), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 300))]
        texts += [" ".join(words), *(" ".join(changed(rng, words, times)) for times in (1, 1, 2, 4))]
    texts += ["", "a", "b", "a b c d e", "a b c d e a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.signatures(df)
    sets = [plain_set(t) for t in texts]
    marks = [plain_mark(s) for s in sets]
    found = rows.collect()
    assert {r["doc_id"]: r["mark"] & (2**64 - 1) for r in found} == dict(enumerate(marks))
    doc = {r["fp"]: r["doc_id"] for r in found}
    label = list(range(len(texts)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if (marks[a] ^ marks[b]).bit_count() <= 4 and jaccard(sets[a], sets[b]) >= 0.8]
    for a, b in near:
        label = [label[a] if x == label[b] else x for x in label]
    links = near_copies.links(df, rows.withColumn("bands", F.array().cast("array<long>")))
    got = list(range(len(texts)))
    for r in components(links).collect():
        got[doc[r["node"]]] = doc[r["label"]]
    classes = lambda of: {frozenset(i for i, y in enumerate(of) if y == x) for x in of}
    assert len(near) > 30 and classes(got) == classes(label)


def test_stage_searches_by_simhash(spark, monkeypatch):
    searched, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *more: searched.append(fps.count()) or links(fps, *more))
    out = P.drop_near_copies(spark, spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "Four  five"), (4, None)], "doc_id long, text string"), "")
    assert searched == [2] and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]
