import random
from collections import Counter
from math import exp, log

import numpy as np

from pavewise.llm import pseudo_lm
from pavewise.llm.pseudo_lm import Net, Shape, Vocabulary

TINY = Shape(width=2, classes=3, per=2, side=1, rare=2)


def tiny_vocabulary():
    counts = np.array([9, 7, 5, 4, 3, 2.0])
    return Vocabulary(TINY, np.arange(6), np.arange(6), counts, np.zeros(6, np.int64), np.array([4.0, 2.0]), np.array([3.0, 1.0]), 36)


def tiny_net(seed=0):
    net = Net.fresh(tiny_vocabulary())
    return Net(TINY, net.rows.astype(float) + np.random.default_rng(seed).normal(0, 0.4, net.rows.shape))


def plain_log_probability(net, left, word, right):
    """By the module's formulas, one number at a time."""
    words, gain, bias, w1, w2, b1, b2 = net.parts
    h = [np.tanh(bias[j] + gain[0][j] * words[left][j] + gain[1][j] * words[right][j]) for j in range(2)]
    logit = [b1[o] + sum(w1[o][j] * h[j] for j in range(2)) for o in range(5)]
    top = lambda o: logit[o] - log(sum(map(exp, logit)))
    if word >= 6:
        return top(3 + word - 6)
    inner = [b2[word // 2][i] + sum(w2[word // 2][i][j] * h[j] for j in range(2)) for i in range(2)]
    return top(word // 2) + inner[word % 2] - log(sum(map(exp, inner)))


def line_of(*docs):
    return pseudo_lm.laid_out([np.array(d, "<u2").tobytes() for d in docs], TINY)


def test_score_by_hand():
    net, docs = tiny_net(), [[0, 3, 6, 5], [], [7], [2, 2, 2]]
    line, place, doc = line_of(*docs)
    spot, found = net.log_probability(line, place)
    got = dict(zip(spot.tolist(), found.tolist(), strict=True))
    want = [plain_log_probability(net, *x) for d in docs for x in zip([8, *d], d, [*d[1:], 8], strict=False)]
    assert np.allclose([got[p] for p in place], want) and doc.tolist() == [0, 0, 0, 0, 2, 3, 3, 3]


def test_probabilities_sum_to_one():
    net = tiny_net(1)
    for left, right in ((0, 5), (8, 7), (6, 8)):
        assert abs(sum(exp(plain_log_probability(net, left, w, right)) for w in range(8)) - 1) < 1e-12
    v = tiny_vocabulary()
    # A bucket's words with the counts 2 and 1 and 1, and an unseen one.
    assert abs((3 + 2 + 2 + 1) / (v.other_n[0] + v.other_d[0] + 1) - 1) < 1e-12


def test_gradient_against_differences():
    net = tiny_net(2)
    line, place, _ = line_of([0, 3, 6, 5, 1], [4, 7, 2])
    grad = Net(TINY, np.zeros_like(net.rows))
    ids, pulled = net.gradient(line, place, grad)
    grad.rows[ids] += pulled
    loss = lambda rows: -Net(TINY, rows).log_probability(line, place)[1].mean()
    for i, j in np.ndindex(net.rows.shape):
        step = np.zeros_like(net.rows)
        step[i, j] = 1e-5
        assert abs((loss(net.rows + step) - loss(net.rows - step)) / 2e-5 - grad.rows[i, j]) < 1e-7


def test_every_word_is_a_target_however_documents_arrive():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 8, n).astype("<u2").tobytes() for n in (0, 1, 5000, 40_000, 3, 90_000)]
    net = Net.fresh(tiny_vocabulary())
    rows, used = pseudo_lm.train_copy(net, iter(docs))
    assert used[Net.starts(TINY)[1]] == sum(len(d) // 2 for d in docs)
    assert np.array_equal(rows, pseudo_lm.train_copy(net, (d for d in docs))[0])


def natural(n=150, seed=1):
    """Two languages that share no word, so that the words around tell which one comes; each document has a word of its own."""
    rng, out = random.Random(seed), []
    for i in range(n):
        own = ["alpha", "beta", "gamma", "delta"] if i % 2 else ["uno", "dos", "tres", "quattro"]
        out.append((i, " ".join([rng.choice(own) for _ in range(120)] + [f"only{i}"])))
    return out


def per_token(df, **settings):
    return {r["doc_id"]: r["per_token"] for r in pseudo_lm.score(df, **settings).collect()}


def test_layout_does_not_matter(spark):
    rows = [*natural(), *natural()[:40], (None, "alpha uno"), (None, "alpha uno")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    three, nine = (per_token(df.repartition(n), rounds=2, known=5, shard_words=4000) for n in (3, 9))
    assert three.keys() == nine.keys() and all(abs(three[k] - nine[k]) < 1e-6 for k in three)


def test_context_is_what_gains_on_documents_held_out(spark):
    train, test = natural(400), [(1000 + i, t) for i, t in natural(40, 7)]
    model, _ = pseudo_lm.fit(spark.createDataFrame(train, "doc_id long, text string"), 2)
    unigram = pseudo_lm.Model(model.vocabulary, model.counts, Net.fresh(model.vocabulary))
    held = spark.createDataFrame(test, "doc_id long, text string")
    rng = random.Random(3)
    every = [w for _, t in test for w in t.split()]
    rng.shuffle(every)
    size = len(every) // len(test)
    mixed = spark.createDataFrame([(i, " ".join(every[k * size : (k + 1) * size])) for k, (i, _) in enumerate(test)], "doc_id long, text string")
    mean = lambda df, m: np.mean(list(per_token(df, model=m).values()))
    assert mean(held, model) > mean(held, unigram) + 0.4
    assert mean(mixed, model) < mean(mixed, unigram)


def test_counts_of_rare_words_come_from_the_whole_corpus(spark):
    """Words beyond those that tasks know have the counts of the table: knowing all or two words gives the same scores."""
    df = spark.createDataFrame(natural(60), "doc_id long, text string").repartition(4)
    shape = Shape(width=2, classes=1, per=2, side=1, rare=4)
    counts = pseudo_lm.word_counts(df, shape)
    want = Counter(w for _, t in natural(60) for w in t.split())
    assert sorted(r["n"] for r in counts.collect()) == sorted(want.values())
    few, all_known = pseudo_lm.vocabulary(counts, shape, 3), pseudo_lm.vocabulary(counts, shape)
    assert len(few.counts) <= 3 < len(all_known.counts) == len(want)
    assert few.total == all_known.total == sum(want.values()) and np.allclose(few.other_n, all_known.other_n)
    one, two = (per_token(df, shape=shape, known=k) for k in (3, 1000))
    assert all(abs(one[k] - two[k]) < 1e-6 for k in two)


def test_word_hashes(texts, monkeypatch):
    """Words as bytes.split() cuts them, one hash for each different word, however texts are cut into pieces."""
    raws = [pseudo_lm.raw_text(t) for _, t in texts] + [b"", b" a", b"b ", b"\t"]
    words = [w for r in raws for w in r.split()]
    whole = pseudo_lm.hashed_words(raws, 64)
    assert whole[2].tolist() == [len(r.split()) for r in raws] and len(whole[0]) == len(words)
    assert len(set(zip(words, whole[0].tolist(), whole[1].tolist(), strict=True))) == len(set(words)) == len(set(whole[0].tolist()))
    monkeypatch.setattr(pseudo_lm, "PIECE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pseudo_lm.hashed_words(raws, 64), strict=True))


def test_odd_rows(odd, none, texts):
    rows = pseudo_lm.score(odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((i, len(t.lower().encode().split())) for i, t in texts)
    assert {r["per_token"] for r in rows if r["doc_id"] in (1, 2, 3)} == {None}
    assert {r["log_likelihood"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert pseudo_lm.score(none).count() == 0
