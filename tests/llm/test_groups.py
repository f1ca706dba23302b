"""Operators 6 and 9, and components."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pavewise.llm import mixing, simhash
from pavewise.llm.graph import components


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(values, bits):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= bits:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in parent}


def test_fingerprint():
    for text in ("", " \n", "One", "a B c", "The quick Brown fox\tjumps over the lazy dog", "É é É é É", "x" * 5000):
        assert int.from_bytes(simhash.fingerprint(text), "big") == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("bits", "bucket"), [(4, 4000), (4, 3), (3, 4000), (3, 3), (2, 1)])
def test_links_connect_all_pairs(spark, bits, bucket):
    rng = random.Random(bits * 10 + bucket)
    values = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(12)}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = components(simhash.links(fps, bits, bucket))
    label = {r["node"] & (2**64 - 1): r["label"] for r in found.collect()}
    want = classes_of(values, bits)
    sizes = Counter(want.values())
    groups = defaultdict(set)
    for v in values:
        groups[want[v]].add(label.get(v, ("alone", v)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(sizes)


def test_allocation_is_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        costs = [[rng.random() * 4**t for t in range(5)] for _ in range(4)]
        options = [(sum(c[t] for c, t in zip(costs, ts, strict=True) if t >= 0), list(ts)) for ts in __import__("itertools").product(range(-1, 5), repeat=4) if sum(t + 1 for t in ts) == 5]
        cost, ts = simhash.allocate(costs, 4)
        assert abs(cost - min(options)[0]) < 1e-12 and sum(t + 1 for t in ts) == 5


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1000, 1002)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes(odd, none, texts):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.classes(odd).collect())
    fps = {t: plain_fingerprint(t) for _, t in texts}
    group = classes_of(set(fps.values()), 4)
    least = {}
    for i, t in texts:
        if i is not None:
            g = group[fps[t]]
            least[g] = min(least.get(g, i), i)
    assert got == Counter((i, fps[t], least.get(group[fps[t]])) for i, t in texts)
    assert simhash.classes(none).count() == 0


def test_keep_one(odd, texts):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    kept = [r[0] for r in out.collect()]
    group = classes_of({plain_fingerprint(t) for _, t in texts}, 4)
    assert len(kept) == len({group[plain_fingerprint(t)] for _, t in texts})
    assert Counter(kept)[6] == 0 and Counter(kept)[5] == 1 and None in kept


def test_targets():
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == [140.0, 20.0, 20.0]
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [20.0, 50 / 3, 25 / 3]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_flow_is_maximal_and_spreads_repetition():
    a, b = frozenset("a"), frozenset("b")
    assert mixing.flow([(a, 100), (a | b, 50), (b, 10)], {"a": 100, "b": 60}, 2) == [100, 50, 10]
    assert sum(mixing.flow([(a, 100), (a | b, 50), (b, 10)], {"a": 150, "b": 90}, 2)) == 240
    assert mixing.flow([(a, 10)], {"a": 999}, 3) == [30]


def test_flow_against_all_allocations():
    """Small cases: no allocation gives more tokens, none as many at less cost; each pattern's amounts are one of the best."""
    from itertools import product

    rng = random.Random(6)
    for _ in range(25):
        names = "ab"
        quotas = {s: rng.randint(0, 4) for s in names}
        patterns = [(frozenset(m), rng.randint(1, 2)) for m in rng.sample([("a",), ("b",), ("a", "b"), ()], 3)]
        cost = lambda i, k: sum(1 + t // patterns[i][1] for t in range(k))  # noqa: E731, B023
        best = {}
        for amounts in product(*[range(2 * n + 1) for _, n in patterns]):
            splits = [[k for k in product(*[range(a + 1) if s in m else (0,) for s in names]) if sum(k) == a] for (m, _), a in zip(patterns, amounts, strict=True)]
            if any(all(sum(x[j] for x in pick) <= quotas[s] for j, s in enumerate(names)) for pick in product(*splits)):
                best[amounts] = (-sum(amounts), sum(cost(i, k) for i, k in enumerate(amounts)))
        got = tuple(mixing.flow(patterns, quotas, 2))
        assert best[got] == min(best.values())


def plain_targets(sizes, weights):
    """By bisection on the price of a unit of weight: each source gets min(weight * price, twice its size)."""
    low, high, goal = 0.0, 1e9, min(1.5 * sum(sizes), 2.0 * sum(sizes))
    for _ in range(200):
        price = (low + high) / 2
        low, high = (price, high) if sum(min(w * price, 2 * n) for w, n in zip(weights, sizes, strict=True)) < goal else (low, price)
    return [min(w * high, 2 * n) for w, n in zip(weights, sizes, strict=True)]


def test_targets_by_bisection():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 1000) for _ in range(5)]
        assert mixing.targets(sizes, [5, 2, 1, 5, 2]) == pytest.approx(plain_targets(sizes, [5, 2, 1, 5, 2]), rel=1e-6)


def test_components_of_a_star_and_equal_fingerprints(spark):
    star = [(0, i) for i in range(1, 2000)] + [(5000, 5001)]
    got = dict(components(spark.createDataFrame(star, "a long, b long")).collect())
    assert got == {i: 0 for i in range(2000)} | {5000: 5000, 5001: 5000}
    rows = [(i, "one text that nine tenths of all rows have") for i in range(900)] + [(1000 + i, f"w{i} x{i} y{i} z{i} v{i}") for i in range(100)]
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 1000 and {r["component_id"] for r in found if r["doc_id"] < 900} == {0}


def test_mix(spark, odd, none, texts):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(800)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(rows, mixing.repeating()).collect()
    again = mixing.mix(rows.repartition(5), mixing.repeating()).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}
    source = {i: s for i, _, s in docs}
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = (r["target"], r["source_size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    names = ["a", "b", "c", None]
    for s, t in zip(names, mixing.targets([size[s] for s in names], [5, 2, 1, 5]), strict=True):
        assert target[s] == (t, size[s]) and abs(taken[s] - t) <= 31
    assert mixing.mix(odd, mixing.repeating()).count() == len(texts) and mixing.mix(none, mixing.repeating()).count() == 0
    assert mixing.mixed_rows(odd, mixing.repeating()).columns == odd.columns


def test_mix_takes_a_part_of_identical_rows(spark):
    rows = spark.range(4000).selectExpr("7L as doc_id", "'a b c d e' as text", "'s' as source")
    got = mixing.mix(rows, mixing.repeating(), share=0.5)
    assert abs(got.selectExpr("sum(taken)").first()[0] - 10000) <= 5


def test_mix_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b"], [], None][i % 5]) for i in range(500)], "doc_id long, text string, source array<string>")
    got = mixing.mix(rows, lambda _, s: {"a": 1.0, "b": 3.0}[s], share=1.0).collect()
    assert len(got) == 500 and {r["copies"] for r in got if r["doc_id"] % 5 > 2} == {0}
    assert abs(sum(r["taken"] for r in got) - 4000) <= 10


def test_more_patterns_than_the_driver_holds(spark, monkeypatch):
    """Fifteen patterns of four sources, of which the driver holds six: documents of the others count for one source each."""
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 6)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 20), sorted(rng.sample("abcd", rng.randint(1, 4)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df, mixing.repeating(), share=1.0).collect()
    assert len(got) == 1500 and {r["doc_id"] for r in got} == set(range(1500)) and max(r["copies"] for r in got) <= 2
    assert 1.0 < sum(r["taken"] for r in got) / sum(r["size"] for r in got) <= 2.0  # overlapping sources share more than all sizes
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(df, mixing.repeating())


def test_flow_of_many_patterns_is_quick():
    import time

    rng, names = random.Random(1), [f"s{i}" for i in range(20)]
    patterns = list({frozenset(rng.sample(names, rng.randint(1, 6))): rng.randint(1, 1000) for _ in range(5000)}.items())
    began = time.process_time()
    used = mixing.flow(patterns, {s: 50_000 * (1 + i) for i, s in enumerate(names)}, 2)
    assert time.process_time() - began < 10 and sum(used) == min(2 * sum(n for _, n in patterns), sum(50_000 * (1 + i) for i in range(20)), sum(used))
