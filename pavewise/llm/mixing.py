"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources are interchangeable, so they are aggregated to one node per pattern. Tokens flow from
patterns to the quotas of their sources; using a pattern for the r-th time costs r for each token (convex), so repetition
is spread before anything is repeated again. The flow fixes how often each pattern is used; the last, partial use takes
documents in the order of a seeded hash up to the amount, found by histograms of the hash that are refined around the
cut, so no source's documents are ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavewise.llm.common import stored, word_count

#: Patterns that the driver holds. Where there are more, documents of the smaller ones count for one of their sources each, by a
#: seeded draw: none is dropped, but those are less free in the flow.
MOST_PATTERNS = 200_000
STEP = 10  # bits of the hash in one refinement
LEVELS = 6  # refinements in each of the two hashes


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes dealt by weight; a target stops at most times its size, the excess is dealt again by weight."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes)]
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def flow(patterns: list[tuple[frozenset, int]], quotas: dict, repeat: int) -> list[int]:
    """Tokens that each pattern gives in a maximal flow of least cost.

    The network is start -> pattern (repeat arcs of its size, the r-th at cost r) -> its sources -> sink (quota). A way to the sink
    leaves the start once, and only those arcs cost anything, so the cheapest ways use the first arcs, then the second ones:
    for each r the flow is made maximal with one more arc a pattern, by blocking flows over shortest ways in arcs.
    Integer capacities, so the result is exact; there are few sources, so few ways are long.
    """
    names = sorted(quotas, key=lambda s: (s is None, s))
    place = {s: i for i, s in enumerate(names)}
    arcs = [sorted(place[s] for s in members) for members, _ in patterns]
    given = [dict.fromkeys(own, 0) for own in arcs]  # flow from pattern to source
    holders: list[dict[int, None]] = [{} for _ in names]  # patterns with flow to a source
    open_, room, used = [int(quotas[s]) for s in names], [0] * len(patterns), [0] * len(patterns)

    def levels() -> tuple[list[int], list[int]] | None:
        """Distances of patterns and sources from the start, null if no source with room is reached."""
        of_pattern, of_source = [-1] * len(patterns), [-1] * len(names)
        now = [i for i, r in enumerate(room) if r > 0]
        for i in now:
            of_pattern[i] = 0
        far, done = 0, False
        while now and not done:
            near = []
            for i in now:
                for s in arcs[i]:
                    if of_source[s] < 0:
                        of_source[s] = far + 1
                        near.append(s)
            done = any(open_[s] > 0 for s in near)
            now = []
            for s in near:
                for i in holders[s]:
                    if of_pattern[i] < 0 and given[i][s] > 0:
                        of_pattern[i] = far + 2
                        now.append(i)
            far += 2
        return (of_pattern, of_source) if done else None

    for _ in range(repeat):
        for i, (_, size) in enumerate(patterns):
            room[i] += size
        while (found := levels()) is not None:
            of_pattern, of_source = found
            left = [iter(a) for a in arcs]
            back = [iter(list(h)) for h in holders]
            for first in [i for i, r in enumerate(room) if r > 0]:
                way: list[tuple[int, int]] = []  # (pattern, source) forward, and (pattern, source) back, by turns
                at, is_source = first, False
                while room[first] > 0:
                    if is_source and open_[at] > 0:
                        least = min([room[first], open_[at], *[given[i][s] for i, s in way[1::2]]])
                        for k, (i, s) in enumerate(way):
                            given[i][s] += least if k % 2 == 0 else -least
                            if given[i][s] > 0:
                                holders[s][i] = None
                            else:
                                holders[s].pop(i, None)
                        room[first] -= least
                        used[first] += least
                        open_[at] -= least
                        way, at, is_source = [], first, False
                        continue
                    if is_source:
                        step = next((i for i in back[at] if of_pattern[i] == of_source[at] + 1 and given[i].get(at, 0) > 0), None)
                    else:
                        step = next((s for s in left[at] if of_source[s] == of_pattern[at] + 1), None)
                    if step is not None:
                        way.append((step, at) if is_source else (at, step))
                        if not is_source:
                            left[at] = chain([step], left[at])  # it may serve again
                        else:
                            back[at] = chain([step], back[at])
                        at, is_source = step, not is_source
                        continue
                    if not way:
                        break
                    i, s = way.pop()  # a dead end: the arc that led here is not tried again
                    at, is_source = (s, True) if is_source is False else (i, False)
                    next(back[at] if is_source else left[at], None)
    return used


def _cuts(rows: DataFrame, amounts: dict[int, int]) -> dict[int, tuple[int, list[int], bool]]:
    """For each pattern number the cut in its seeded order: refinements done, the prefix, whether the prefix itself is taken.

    Everything below the prefix is taken. rows: (p, size, h1, h2) with hashes of STEP * LEVELS bits. One narrow job for each
    refinement; refinement ends where a cut's cell holds one document, and identical rows are parted by the second hash.
    """
    spark = rows.sparkSession
    state = {p: (0, 0, amount) for p, amount in amounts.items() if amount > 0}  # hash-1 prefix, hash-2 prefix, left
    done: dict[int, tuple[int, list[int], bool]] = {}
    for level in range(1, 2 * LEVELS + 1):
        if not state:
            break
        now = spark.createDataFrame([(p, a, b) for p, (a, b, _) in state.items()], "p int, a long, b long")
        one, two = min(level - 1, LEVELS), max(0, level - 1 - LEVELS)
        shift = lambda col, n: F.shiftright(F.col(col), STEP * (LEVELS - n))
        inside = rows.join(F.broadcast(now), "p").filter((shift("h1", one) == F.col("a")) & (shift("h2", two) == F.col("b")))  # at most MOST_PATTERNS narrow rows
        digit = (shift("h1", level) if level <= LEVELS else shift("h2", level - LEVELS)).bitwiseAND(F.lit((1 << STEP) - 1))
        cells = inside.groupBy("p", digit.alias("d")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        upto = F.sum("s").over(Window.partitionBy("p").orderBy("d"))  # 2 ** STEP cells for each pattern
        left = spark.createDataFrame([(p, r) for p, (_, _, r) in state.items()], "p int, r long")
        over = cells.withColumn("upto", upto).join(F.broadcast(left), "p").filter("upto > r")
        cut = {r["p"]: r["k"] for r in over.groupBy("p").agg(F.min(F.struct("d", "s", "n", "upto")).alias("k")).collect()}
        for p, (a, b, r) in list(state.items()):
            if p not in cut:  # everything in the cell fits
                done[p] = (level - 1, [a, b], True)
                del state[p]
                continue
            k = cut[p]
            a, b = (a << STEP | k["d"], b) if level <= LEVELS else (a, b << STEP | k["d"])
            r -= k["upto"] - k["s"]
            state[p] = (a, b, r)
            if k["n"] == 1 or level == 2 * LEVELS:
                done[p] = (level, [a, b], 2 * r >= k["s"])
                del state[p]
    return done


def mix(df: DataFrame, weight_of: Callable[[int, str | None], float], share: float = 1.5, repeat: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size=word_count, carry: bool = False) -> DataFrame:
    """(doc_id, text_hash, size, copies, taken, source_size, target), one row for each row of df.

    source_col: a string, or an array of strings where sources overlap (its source_size and target are then null, as no
    single one holds). Sources rank by code point, null last; weight_of(rank, source) gives weights. copies is how often
    the mix takes the document (0 to repeat), taken = copies * size. Null text has size 0 and follows its pattern's
    draw. Rows that repeat a doc_id with the same text are drawn apart, which of them is without meaning. The order is a
    hash of doc_id, text and seed, so reruns and other partitionings agree. An empty table gives none.

    carry: give df's own columns and ``copies`` as the last one instead, for a caller that goes on with the rows.
    """
    names = df.columns
    at = {new: F.col(f"c{names.index(old)}").alias(new) for new, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))}
    docs = df.toDF(*[f"c{i}" for i in range(len(names))])
    own = [f"c{i}" for i in range(len(names))] if carry else []
    docs = docs.select(*own, *at.values())
    many = docs.schema["source"].dataType.typeName() == "array"
    mask = F.lit((1 << STEP * LEVELS) - 1)
    key = lambda *c: F.xxhash64(*c).bitwiseAND(mask)
    sources = F.coalesce(F.array_sort(F.array_distinct("source")), F.array().cast("array<string>")) if many else F.array(F.col("source").cast("string"))
    rows = docs.select(*own, "doc_id", F.xxhash64("text").alias("text_hash"), size(F.col("text")).alias("size"), sources.alias("sources"))
    rows = rows.withColumns({"h1": key(F.col("doc_id"), F.col("text_hash"), F.lit(seed)), "row": F.monotonically_increasing_id()})
    rows = stored(rows, "mix-rows").withColumn("h2", key(F.col("row"), F.lit(seed)))
    # Equality of arrays, nulls in them included, by their JSON form.
    named = F.to_json(F.struct("sources"))
    sums = rows.groupBy("sources").agg(F.sum("size").alias("size"))
    if many and sums.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        top = sums.select(named.alias("named"), "size").orderBy(F.desc("size"), "named").limit(MOST_PATTERNS // 2).select("named", F.lit(True).alias("_top"))
        one = F.array(F.get("sources", F.pmod(F.xxhash64("h1", F.lit("source")), F.size("sources")).cast("int")))
        kept = F.col("_top").isNotNull() | (F.size("sources") < 2)
        rows = rows.withColumn("named", named).join(F.broadcast(top), "named", "left").withColumn("sources", F.when(kept, F.col("sources")).otherwise(one)).drop("named", "_top")
        rows = stored(rows, "mix-narrowed")
        sums = rows.groupBy("sources").agg(F.sum("size").alias("size"))
    found = sums.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS // 2} sources")
    if not found and carry:
        return rows.select(*own, F.lit(0).alias("copies")).toDF(*names, "copies")
    if not found:
        return rows.select("doc_id", "text_hash", "size", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"))
    patterns = sorted(((tuple(r["sources"] or ()), int(r["size"])) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    ranked = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for p, n in patterns if s in p) for s in ranked]
    aims = dict(zip(ranked, targets(sizes, [weight_of(i, s) for i, s in enumerate(ranked)], share, repeat), strict=True))
    given = flow([(frozenset(p), n) for p, n in patterns], {s: round(t) for s, t in aims.items()}, repeat)
    whole = [min(repeat, g // n) if n else 0 for g, (_, n) in zip(given, patterns, strict=True)]
    size_of = dict(zip(ranked, sizes, strict=True))
    numbered = rows.sparkSession.createDataFrame(
        [(i, list(p), w, size_of[p[0]] if len(p) == 1 else None, aims[p[0]] if len(p) == 1 else None) for i, ((p, _), w) in enumerate(zip(patterns, whole, strict=True))],
        "p int, sources array<string>, whole int, source_size long, target double",
    )
    # At most MOST_PATTERNS rows are broadcast.
    rows = rows.withColumn("named", named).join(F.broadcast(numbered.withColumn("named", named).drop("sources")), "named")
    cuts = _cuts(rows.select("p", "size", "h1", "h2"), {i: g - w * n for i, (g, w, (_, n)) in enumerate(zip(given, whole, patterns, strict=True))})
    table = rows.sparkSession.createDataFrame([(p, min(level, LEVELS), max(0, level - LEVELS), a, b, last) for p, (level, (a, b), last) in cuts.items()], "p int, l1 int, l2 int, a long, b long, last boolean")
    x = F.expr(f"shiftright(h1, {STEP} * ({LEVELS} - l1))")
    y = F.expr(f"shiftright(h2, {STEP} * ({LEVELS} - l2))")
    drawn = (x < F.col("a")) | ((x == F.col("a")) & ((y < F.col("b")) | ((y == F.col("b")) & F.col("last"))))
    out = rows.join(F.broadcast(table), "p", "left").withColumn("copies", F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("int"))
    if carry:
        return out.select(*own, "copies").toDF(*names, "copies")
    return out.select("doc_id", "text_hash", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_size", "target")


def mixed_rows(df: DataFrame, weight_of: Callable[[int, str | None], float], **options) -> DataFrame:
    """df's rows as often as the mix takes them, columns, clashing names too, as they came.

    Null and empty texts have no words and are taken as their source's draw has it, a very long text as one document; a null source is a
    source of its own; repeated rows are drawn one by one; an empty table gives none.
    """
    out = mix(df, weight_of, carry=True, **options)
    names = df.columns
    flat = out.toDF(*[f"c{i}" for i in range(len(names))], "copies")
    often = flat.select(*[f"c{i}" for i in range(len(names))], F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_"))
    return often.drop("_").toDF(*names)


def repeating(weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> Callable[[int, str | None], float]:
    """Weights that repeat along the sources' order."""
    return lambda rank, _: weights[rank % len(weights)]
