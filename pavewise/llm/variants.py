"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under their commonest form.

A word's near words agree with it exactly on its first half or on its second half. Dictionary words meet the words that ask
by a shuffle on that half, read forward or backward. Each task builds minimal acyclic automata of its sorted words (those
read backward as their mirror images), with word numbers as a perfect hash; a word that asks walks its half exactly and
completes with one error. A near word that agrees on the first half is taken forward alone, so none is counted twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import discard, pick, prepare, stored

RUN = re.compile("[a-zÀ-ÿ]+")
TYPO = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Different words a task holds before it sends their counts on.
HELD = 400_000
#: Words of one automaton; halves that more words share are dealt out in blocks.
BLOCK = 100_000


class Automaton:
    """Minimal acyclic automaton of words in ascending order, all different; a word's number is its place among them.

    A state's edges lead to (state, how many words of the state come before those of the edge).
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""

        def settle(edges: dict[str, int], final: bool) -> int:
            key = (final, *edges.items())
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.edges)
                before, steps = int(final), {}
                for c, to in edges.items():
                    steps[c] = (to, before)
                    before += size[to]
                self.edges.append(steps)
                self.final.append(final)
                size.append(before)
            return at

        for word in [*words, ""]:
            same = 0
            while same < len(word) and same < len(last) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                edges, final = path.pop()
                path[-1][0][last[len(path) - 1]] = settle(edges, final[0])
            for _ in range(same, len(word)):
                path.append(({}, [False]))
            if word:
                path[-1][1][0] = True
            last = word
        self.root = settle(path[0][0], False)

    def walk(self, at: int, number: int, rest: str) -> tuple[int, int] | None:
        edges = self.edges
        for c in rest:
            step = edges[at].get(c)
            if step is None:
                return None
            at, number = step[0], number + step[1]
        return at, number

    def number(self, word: str) -> int | None:
        """The word's place, null if it is none of the words."""
        end = self.walk(self.root, 0, word)
        return end[1] if end and self.final[end[0]] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of words that begin with word[:half] and differ from word by one inserted, deleted or replaced character."""
        found: set[int] = set()
        start = self.walk(self.root, 0, word[:half])
        if start is None:
            return found
        edges, final, n = self.edges, self.final, len(word)
        at, number = start
        for p in range(half, n + 1):
            here = edges[at]
            own = word[p] if p < n else ""
            tries = [(at, number, p + 1)] if own else []  # word[p] deleted
            for c, (to, before) in here.items():
                following = edges[to]
                if own and c != own and (word[p + 1] in following if p + 1 < n else final[to]):
                    tries.append((to, number + before, p + 1))  # replaced
                if own in following if own else final[to]:
                    tries.append((to, number + before, p))  # c inserted
            for to, count, i in tries:
                while i < n:
                    step = edges[to].get(word[i])
                    if step is None:
                        break
                    to, count, i = step[0], count + step[1], i + 1
                else:
                    if final[to]:
                        found.add(count)
            step = here.get(own)
            if step is None:
                break
            at, number = step[0], number + step[1]
        return found


def spelled(text: str, doc_id: str) -> Counter[str]:
    """Runs of letters in lower case (A-Z alone are lowered), those whose crc32 with the doc_id TYPO divides with one letter less."""
    runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    start, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    out: Counter[str] = Counter()
    for run, n in runs.items():
        h = crc(run.encode(), start)
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all different results with at least LEAST_LENGTH characters and ``least`` occurrences."""
    prepare(df.sparkSession)
    docs = pick(df, doc_id=id_col, text=text_col).filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        packed = lambda: pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in spelled(text, doc_id).items():
                    held[word] += n
                if len(held) >= HELD:
                    yield packed()
                    held.clear()
        yield packed()

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halves(words: DataFrame) -> DataFrame:
    """(backward, word, n, half, asks): each word, or its mirror image, under the two halves by which words may look for it.

    A word of length L asks with its first L // 2 characters forward and with its last L - L // 2 backward; words that are
    one longer, as long or one shorter look for it with one of two lengths each way.
    """
    size = F.length("word")
    ways = []
    for backward in (False, True):
        text = F.reverse("word") if backward else F.col("word")
        up = 1 if backward else 0
        own = F.floor((size + up) / 2).cast("int")
        low = F.floor((size + up - 1) / 2).cast("int")
        lengths = F.explode(F.array(low, low + 1)).alias("length")
        ways.append(words.select(F.lit(backward).alias("backward"), text.alias("word"), "n", own.alias("own"), lengths))
    rows = ways[0].union(ways[1])
    return rows.select("backward", "word", "n", F.substring("word", F.lit(1), F.col("length")).alias("half"), (F.col("length") == F.col("own")).alias("asks"))


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """rows with a cell: 0, or, where over ``block`` rows share a half, blocks of dictionary words by blocks of asking words.

    A half in that table has ``block`` rows or more, so the table is that much smaller than the rows, and is broadcast
    only below a million halves.
    """
    hot = stored(rows.groupBy("backward", "half").count().filter(F.col("count") > block).select("backward", "half", F.ceil(F.col("count") / block).cast("int").alias("parts")), "crowded-halves")
    n = hot.count()
    if not n:
        return rows.withColumns({"cell": F.lit(0).cast("long"), "listed": F.lit(True)})
    parted = rows.join(F.broadcast(hot) if n < 1_000_000 else hot, ["backward", "half"], "left")
    own, ask = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.pmod(F.xxhash64(F.lit("ask"), "word"), F.col("parts")).cast("int")
    steps = F.sequence(F.lit(0), F.col("parts") - 1)
    listed = F.transform(steps, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("listed"), (F.col("asks") & (j == ask)).alias("asks")))
    asking = F.transform(F.filter(steps, lambda i: F.col("asks") & (i != own)), lambda i: F.struct(i.alias("i"), ask.alias("j"), F.lit(False).alias("listed"), F.lit(True).alias("asks")))
    plain = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("listed"), F.col("asks")))
    out = parted.select("backward", "word", "n", "half", "parts", F.explode(F.when(F.col("parts").isNull(), plain).otherwise(F.concat(listed, asking))).alias("c"))
    cell = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("backward", "half", "c.i", "c.j"))
    return out.select("backward", "word", "n", "half", "c.asks", cell.alias("cell"), "c.listed")


def _answers(rows: list[tuple[str, int, bool, bool]], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for the rows (word, n, asks, listed), in ascending order, that ask and find."""
    words, counts, asking = [], [], []
    for word, n, asks, listed in rows:
        if listed and (not words or words[-1] != word):
            words.append(word)
            counts.append(n)
        if asks:
            asking.append(word)
    automaton = Automaton(words)
    for word in asking:
        half = (len(word) + backward) // 2
        near = automaton.near(word, half)
        if backward:
            near = {i for i in near if not words[i].endswith(word[half:])}
        if near:
            named = [(-counts[i], words[i][::-1] if backward else words[i]) for i in near]
            least, best = min(named)
            yield (word[::-1] if backward else word), len(near), -least, best


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; all different) that have near words among them."""
    many = words.count()
    cells = _cells(_halves(words), block)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * many // block))
    dealt = cells.repartition(tasks, "backward", "half", "cell").sortWithinPartitions("backward", "cell", "word")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bool, bool]] = []
        key = None

        def answered(backward: bool) -> pa.RecordBatch:
            found = list(_answers(held, backward))
            return pa.record_batch([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            for backward, cell, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (backward, cell) != key:
                    if held:
                        yield answered(key[0])
                    held, key = [], (backward, cell)
                held.append(tuple(row))
        if held:
            yield answered(key[0])

    found = dealt.select("backward", "cell", "word", "n", "asks", "listed").mapInArrow(look, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word when forms are followed. Counts double at each step, so chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = stored(now.select("word", "root"), "roots")
        discard(step)


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word; see the module and RATIO.

    Null and empty texts have no words; a text of any length is read whole; rows that repeat count again; a null doc_id
    stands as the empty text in front of its runs. An empty table gives none. Equal counts go to the word smallest in
    code-point order. Extra columns, whatever their names, are not looked at.
    """
    words = stored(vocabulary(df, id_col, text_col), "words")
    near = near_words(words, block)
    formed = F.col("best_n") >= RATIO * F.col("n")
    both = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "word-forms")
    root = _roots(both.filter("form is not null").select("word", "form"))
    return both.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
