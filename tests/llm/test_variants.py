"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pavewise.llm import variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    a = variants.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("ab") is None and a.number(words[0] + "b") is None

    def right(state):
        return frozenset(([""] if a.final[state] else []) + [c + r for c, (to, _) in a.edges[state].items() for r in right(to)])

    languages = [right(s) for s in range(len(a.edges))]
    assert len(set(languages)) == len(languages)  # no two states stand for the same endings
    assert variants.Automaton([]).near("abcde", 2) == set()


def test_near_either_way():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(200)})
    mirrored = sorted(w[::-1] for w in words)
    forward, backward = variants.Automaton(words), variants.Automaton(mirrored)
    for w in words:
        h, g = len(w) // 2, len(w) - len(w) // 2
        found = [words[i] for i in forward.near(w, h)] + [v for v in (mirrored[i][::-1] for i in backward.near(w[::-1], g)) if not v.startswith(w[:h])]
        assert sorted(found) == [v for v in words if one_apart(w, v)]


def corpus(seed):
    rng, rows = random.Random(seed), []
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 10))) for _ in range(60)]
    for i in range(120):
        words = []
        for _ in range(80):
            w = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("abcX"), w[at] + rng.choice("abc")]) + w[at + 1 :]
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return [*rows, (500, "lantern " * 16 + "Lanterm " * 7 + "lanterma " * 3)]


@pytest.mark.parametrize("block", [variants.BLOCK, 7])
def test_against_brute_force(spark, block):
    """With blocks of seven words most halves are dealt out in cells."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert len(want) > 200 and any(w[1] and w[1] != w[2] for w in want)
    assert got(variants.group(df, block=block)) == want


def test_one_half_holds_most_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["prefix" + "".join(rng.choice("abc") for _ in range(4))] * 2)) for i in range(300)]
    assert got(variants.group(spark.createDataFrame(rows, "doc_id long, text string"), block=20)) == plain(rows)


def test_odd_rows(odd, none, texts):
    assert got(variants.group(odd)) == plain(texts)
    assert variants.group(none).count() == 0


def test_one_long_run_and_many_words():
    assert variants.spelled("x" * 1_000_000, "1").total() == 1
    assert defaultdict(int, variants.spelled("Abcde " * 200_000, "1"))["abcde"] in (0, 200_000)
