"""Operator 11 against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pavewise.llm import part_enum


def plain_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(rows):
    """Sorted (doc_id, set size, smallest id reachable)."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
            root[b] = a
    return sorted((str(i), len(s), str(rows[top(k)][0])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [out[at], f"new{rng.randrange(10**6)}"]))
    return out


def test_bands_and_instances():
    assert all(b[0] == a[1] + 1 for a, b in zip(part_enum.BANDS, part_enum.BANDS[1:], strict=False))
    for a in range(1, 700):
        own = {i for i, _, _ in part_enum.instances(a)}
        for b in range(a, 5 * a // 4 + 1):
            shared = own & {i for i, _, _ in part_enum.instances(b)}
            assert shared and all(k >= (a + b) // 9 for i, k, _ in part_enum.instances(a) if i in shared)


@pytest.mark.parametrize("frequent", ["none", "half", "all"])
def test_similar_sets_share_a_signature(frequent):
    """Whatever shingles are called frequent; sizes 1 to 400 and the least similarity that counts."""
    rng = np.random.default_rng(4)
    for size in [*range(1, 60), *range(60, 400, 7)]:
        for _ in range(6):
            union = rng.integers(0, 1 << 63, size, np.uint64)
            common = -(-4 * size // 5)
            gone = rng.permutation(size)[: size - common]
            cut = rng.integers(0, len(gone) + 1)
            a, b = np.sort(np.delete(union, gone[:cut])), np.sort(np.delete(union, gone[cut:]))
            listed = np.sort({"none": union[:0], "half": rng.permutation(union)[: size // 2], "all": union}[frequent])
            assert np.intersect1d(part_enum.signatures(a, listed), part_enum.signatures(b, listed)).size


def test_groups_in_any_batches():
    rng = random.Random(8)
    rows = sorted({(v, f) for v in range(60) for f in rng.sample(range(50), rng.choice((1, 1, 2, 3, 5, 9)))} | {(30, f) for f in range(50)})
    rows = sorted(rows + rng.sample(rows, 40))  # copies
    members = {v: sorted({f for w, f in rows if w == v}) for v, _ in rows}
    want = {(False, a, b) for fs in members.values() if len(fs) <= 4 for a, b in combinations(fs, 2)} | {(True, v, f) for v, fs in members.items() if len(fs) > 4 for f in fs}
    for size in (1, 2, 3, 7, 50, 1000):
        groups, out = part_enum.Groups(4), set()
        for at in [*range(0, len(rows), size), None]:
            part = np.array(rows[at : at + size] if at is not None else np.empty((0, 2)), np.int64).reshape(-1, 2)
            out |= set(zip(*[x.tolist() for x in groups.add(part[:, 0], part[:, 1], last=at is None)], strict=True))
        assert out == want


def corpus(seed):
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(40)]
    for _ in range(50):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 6, 9, 14, 40, 120, 300)))]
        if rng.random() < 0.5:
            words[3:3] = passage
        rows.append(" ".join(words))
        rows += [" ".join(changed(rng, words, max(1, round(len(words) * share)))) for share in (0.006, 0.012, 0.018, 0.022, 0.03)]
    rows += [rows[0], rows[0].upper(), None, "", " \n", "one two", "One  two", "alone", "two one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd", [2, 30])
def test_against_brute_force(spark, crowd):
    rows = corpus(crowd)
    want = plain(rows)
    assert sum(n > 1 for n in Counter(c for _, _, c in want).values()) > 25
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(part_enum.classes(df, crowd=crowd)) == want


def test_lists_change_no_link(spark, monkeypatch):
    """Every text in the sample, low limits: most shingles are frequent and many signatures are dealt out by set."""
    monkeypatch.setattr(part_enum, "SAMPLE", 1)
    monkeypatch.setattr(part_enum, "FREQUENT", 2)
    monkeypatch.setattr(part_enum, "SHARED", 3)
    rows = corpus(77)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frequent, common = part_enum.frequent_lists(df)
    assert len(frequent) > 100 and len(common) > 10
    assert got(part_enum.classes(df)) == plain(rows)


def test_one_template_and_copies_hold_most_rows(spark):
    rng = random.Random(3)
    base = [f"c{k}" for k in range(100)]
    texts = ["the same words again and again in most of all rows"] * 300 + [" ".join(base), *[" ".join(changed(rng, base, rng.choice((1, 2, 3)))) for _ in range(80)]]
    rows = list(enumerate(texts))
    assert got(part_enum.classes(spark.createDataFrame(rows, "doc_id long, text string"), crowd=5)) == plain(rows)


def test_odd_rows(odd, none, texts):
    found = got(part_enum.classes(odd))
    assert found == plain(texts)
    assert part_enum.classes(none).count() == 0
