"""Toxicity by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are rates, so that length matters little: insult lexicons, fixed and learned from labels, their nearness to
second-person words, capitals, punctuation, and obfuscated spellings. Trees and calibration are fitted in numpy on at most ``bound`` labelled rows (a
classifier's bounded sample, by hash order); every document is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import crc_mod, pick, prepare, stored

#: Labelled rows that are fitted on, at most.
BOUND = 20_000

#: Insults and slurs against persons, by language (fixed values).
INSULTS = (
    "idiot idiots moron morons loser losers scum trash garbage worthless pathetic stupid disgusting clown clowns dumb fool fools jerk jerks "
    "imbecile cretin vermin filth filthy pig pigs creep freak retard bastard bitch asshole dickhead shithead dumbass scumbag lowlife bully "
    "idiota idiotas imbécil estúpido estúpida basura inútil tonto tonta cabrón gilipollas asqueroso payaso patético escoria "
    "imbécile crétin stupide ordure pathétique minable abruti connard connasse salaud dégoûtant bouffon débile racaille "
    "dummkopf trottel vollidiot schwachkopf abschaum dreckig widerlich erbärmlich wertlos blödmann arschloch versager drecksau"
).split()
#: Hostile acts and wishes (fixed values).
HOSTILE = "hate die kill shut hurt despise loathe odio muere cállate hais crève tais hasse stirb".split()
#: Second-person words (fixed values).
SECOND = frozenset("you your yours yourself u ur tu tú te ti vos usted ustedes tus toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "+": "t"})
NEAR = 5
FEATURES = ("insult_rate", "insults_different", "hostile_rate", "learned_rate", "learned_different", "hits_near_second", "capital_rate", "shouted_rate", "exclaim_rate", "run_rate", "masked_rate", "masked_insults", "log_words")
#: Lengths of word beginnings that a learned lexicon may hold besides whole words.
SHORTEST, LONGEST = 3, 8

INSULT_SET, HOSTILE_SET = frozenset(INSULTS), frozenset(HOSTILE)
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[A-Z]{3,}")
RUN = re.compile(r"[!?]{2,}")
#: From the start of a run of letters alone and without going back, so that time is linear in the text.
MASKED = re.compile(r"(?<![a-z])[a-z]++[@$!*#+013457]++[a-z]++(?:[@$!*#+013457]++[a-z]++)*+")
STRETCH = re.compile(r"([^\W\d_])\1{2,}")
#: A run of letters longer than this is no insult.
WORD_MOST = 40
MASKS = [ord(c) for c in "@$!*#+013457"]


class Lexicon:
    """Insults and hostile words of the fixed lists, and learned words and word beginnings."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.learned = learned
        self.first = {w[:SHORTEST] for w in (*INSULT_SET, *HOSTILE_SET, *learned)}

    def knows(self, word: str) -> bool:
        return word in self.learned or any(word[:n] in self.learned for n in range(SHORTEST, min(LONGEST, len(word)) + 1))


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The FEATURES of one whole text in time linear in its length; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    low, first = text.lower(), lexicon.first
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    tokens = low.split()
    per = 100.0 / max(1, len(tokens))
    insults, hostile, learned, near = [], 0, [], 0
    for i, token in enumerate(tokens):
        if token[:3] in first or not token[0].isalnum():
            if not (m := WORD.search(token)):
                continue
            word = m[0]
            hit = word in INSULT_SET
            if hit:
                insults.append(word)
            if word in HOSTILE_SET:
                hostile += 1
            if lexicon.knows(word):
                hit = True
                learned.append(word)
            if hit:
                around = {x for t in tokens[max(0, i - NEAR) : i + NEAR + 1] for x in WORD.findall(t)}
                near += not SECOND.isdisjoint(around)
    masked = hidden = 0
    if counts[MASKS].any():
        for m in MASKED.findall(low):
            masked += 1
            hidden += m.translate(LEET) in INSULT_SET
    for m in STRETCH.finditer(low):
        a, b = m.span()
        masked += 1
        word = (WORD.findall(low[max(0, a - 20) : a]) or [""])[-1] if a and low[a - 1].isalpha() else ""
        rest = WORD.match(low, b, b + WORD_MOST)
        hidden += word + m[1] + (rest[0] if rest else "") in INSULT_SET
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    return [
        len(insults) * per,
        float(len(set(insults))),
        hostile * per,
        len(learned) * per,
        float(len(set(learned))),
        near * per,
        counts[65:91].sum() / letters,
        len(SHOUT.findall(text)) * per,
        (counts[33] + counts[63]) * per,
        len(RUN.findall(text)) * per if counts[33] + counts[63] > 1 else 0.0,
        masked * per,
        float(hidden),
        float(np.log1p(len(tokens))),
    ]


@dataclass
class Trees:
    """Complete trees of one depth: split feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner] if node.size else 0
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: float = 3.0) -> Trees:
    """Logistic loss, second-order gains on histograms of quantile bins; ties go to the lower feature and threshold."""
    n, k = x.shape
    edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins)[1:-1])) if len(np.unique(c)) > 1 else np.zeros(0) for c in x.T]
    b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(p / (1 - p))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    margin = np.full(n, model.base)
    cell = b + np.arange(k) * bins
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            wide, first = 2**d, 2**d - 1
            at = ((node - first)[:, None] * (k * bins) + cell).ravel()
            g = np.bincount(at, np.repeat(grad, k), wide * k * bins).reshape(wide, k, bins)
            h = np.bincount(at, np.repeat(hess, k), wide * k * bins).reshape(wide, k, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
            gain[(hl < least / 10) | (ha - hl < least / 10)] = 0
            for i in range(wide):
                f, c = divmod(int(gain[i].argmax()), bins)
                if gain[i, f, c] > 1e-6 and c < len(edges[f]):
                    model.feature[t, first + i], model.threshold[t, first + i] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.threshold[t][node])
        leaf = node - (2**depth - 1)
        gs, hs = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        model.value[t] = -rate * gs / (hs + penalty)
        margin += model.value[t][leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both non-decreasing; each block is smoothed by half a row of each class."""
    values, at = np.unique(score, return_inverse=True)
    total, ones = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for v, n, s in zip(values, total, ones, strict=True):
        blocks.append([v, v, n, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n1, s1 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + n1, blocks[-1][3] + s1]
    knots = [(x, (s + 0.5) / (n + 1)) for lo, hi, n, s in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])


@dataclass
class Model:
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    lexicon: Lexicon | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.knots[1][0])
        return np.interp(self.trees.margin(x), *self.knots) if len(x) else np.zeros(0)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """Trees on the rows whose fold is not 0, calibrated on those whose fold is 0. One class alone gives its constant rate."""
    y = y.astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, (np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    train = fold != 0
    if y[train].min(initial=1) == y[train].max(initial=0) or y[~train].min(initial=1) == y[~train].max(initial=0):
        train = np.ones(len(y), bool)
    trees = boost(x[train], y[train])
    held = ~train if not train.all() else train
    return Model(trees, isotonic(trees.margin(x[held]), y[held]))


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t or "", lexicon) for t in batch], dtype=object)

    return of(text)


def learn_lexicon(rows: DataFrame, most: int = 4000, ratio: float = 15.0) -> frozenset[str]:
    """Words and word beginnings that mark toxic texts in labelled rows (text, toxic): insults in any language.

    A unit counts once for each different text. It is taken if at least 3 toxic texts, and a 200th of them, hold it, and
    its share of toxic texts is ``ratio`` times that of others; the ``most`` strongest are kept. rows is a bounded sample.
    """
    units = F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))), lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.substring(w, F.lit(1), n))))))).alias("unit")
    texts = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = dict(texts.groupBy("toxic").count().collect())
    if not n.get(1):
        return frozenset()
    least = max(3, n[1] // 200)
    bad = texts.filter("toxic = 1").select(units).filter(F.length("unit") >= SHORTEST).groupBy("unit").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "unit").limit(10 * most)
    fine = texts.filter("toxic = 0").select(units).join(F.broadcast(bad.select("unit")), "unit").groupBy("unit").agg(F.count("*").alias("fine"))  # 10 * most units at most
    both = bad.join(fine, "unit", "left").select("unit", F.col("count").alias("bad"), F.coalesce("fine", F.lit(0)).alias("fine"))
    strength = ((F.col("bad") + 0.5) / (n[1] + 1)) / ((F.col("fine") + 0.5) / (n.get(0, 0) + 1))
    return frozenset(r["unit"] for r in both.filter(strength >= ratio).orderBy(F.desc(strength), "unit").limit(most).collect())


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``bound`` labelled documents, those of smallest hash among rows with crc32(doc_id) mod 5 <> 0.

    Half of the sample teaches the lexicon, the other half trees and calibration, so that learned words are not trusted
    for having been learned. Labels, language, source and doc_id are no features. Rows without label or doc_id are left
    out; a doc_id labelled twice counts as toxic if any label says so; of repeated documents one is used. The ids of the
    sample (bound of them at most) are broadcast, and the sample's texts written once, so the corpus is not shuffled.
    Without labelled rows, as in an empty table, the model scores every text alike and under one half. A very long text is
    one row of features like any other.
    """
    prepare(docs.sparkSession)
    known = pick(labels, doc_id=id_col, toxic=label_col).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.filter(crc_mod(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")
    half = F.abs(F.xxhash64(F.lit("half"), "doc_id")) % 2
    rows = stored(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", half.alias("half")), "toxic-sample")
    lexicon = Lexicon(learn_lexicon(rows.filter("half = 0").select("text", "toxic")))
    x = rows.filter("half = 1").select("doc_id", "toxic", feature_column(F.col("text"), lexicon).alias("x"))
    got = sorted((r["doc_id"], r["r"]["x"], r["r"]["toxic"]) for r in x.groupBy("doc_id").agg(F.min(F.struct("x", "toxic")).alias("r")).collect())
    model = fit_rows(np.array([g[1] for g in got]).reshape(-1, len(FEATURES)), np.array([g[2] for g in got]), np.arange(len(got)) % 4)
    return Model(model.trees, model.knots, lexicon)


def score_column(model: Model) -> Callable[[Column], Column]:
    """A column function: calibrated chance (0 to 1) that a text is toxic; null counts as the empty text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t or "", model.lexicon) for t in batch], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x), dtype="float64")

    return score


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null doc_id is never held out; repeated rows score alike.

    Null and empty texts have a score as well, very long ones are scored whole, an empty table gives none, and extra columns,
    whatever their names, are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", score_column(model)(F.col("text")).alias("score"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores at least ``at``; columns, clashing names too, as they came.

    Null and empty texts have a score like any other, very long ones are scored whole, repeated rows stay or go together, and
    an empty table gives none.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.filter(score_column(model)(F.col(f"c{names.index(text_col)}")) < at).toDF(*names)
