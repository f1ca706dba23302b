"""Standardisation, ranks, quantile bins, correlations and preference models."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavewise.guard import check
from pavewise.session import checkpointed, importable

EPS = 1e-9
#: Rows in the bracket of a percentile that the driver may get, and the sketch's accuracy.
HELD, SKETCH = 10_000, 10_000


def with_scalar(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row of df beside the one row of stats."""
    return df.crossJoin(F.broadcast(stats))  # one row, by construction of an aggregate without keys


def zscore(df: DataFrame, cols: list[str], ddof: int, population: DataFrame | None = None) -> DataFrame:
    """df with z_<col>: mean and deviation (sample for ddof 1, population for 0) of the population, df itself by default."""
    std = F.stddev_samp if ddof else F.stddev_pop
    stats = (population or df).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), std(c).alias(f"_s_{c}"))])
    out = with_scalar(df, stats)
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + EPS) for c in cols})
    return out.drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def log_scaled(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def order_statistics(rows: DataFrame, ranks: dict[str, list[int]], n: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values at these ranks (from 0) among the n finite values of each column, exactly; all columns in the same passes.

    A mergeable sketch gives two values around each rank; counts tell whether the rank is one of theirs or strictly between
    them, where at most 4 / SKETCH of the rows are left. That goes on until at most HELD rows are between, whose different
    values the driver gets. rows must be cheap to read.
    """
    keys = [(c, r) for c, rs in ranks.items() for r in rs]
    names = {k: f"_{i}" for i, k in enumerate(keys)}
    out: dict[tuple[str, int], float] = {}
    at = {k: (float("-inf"), float("inf"), 0, n[k[0]]) for k in keys}  # bounds, rows up to the lower one, rows between them
    while wide := [k for k in keys if k not in out and at[k][3] > HELD]:
        inside = {k: F.when((F.col(k[0]) > at[k][0]) & (F.col(k[0]) < at[k][1]), F.col(k[0])) for k in wide}
        share = {k: (k[1] - at[k][2]) / max(at[k][3] - 1, 1) for k in wide}
        ends = rows.agg(*[F.percentile_approx(inside[k], [max(0.0, share[k] - 2 / SKETCH), min(1.0, share[k] + 2 / SKETCH)], SKETCH).alias(names[k]) for k in wide]).first()
        sides = lambda x, lo, hi: (("l", x < lo), ("a", x == lo), ("i", (x > lo) & (x < hi)), ("b", x == hi))
        counts = rows.agg(*[F.count_if(c).alias(f"{w}{names[k]}") for k in wide for w, c in sides(F.col(k[0]), *ends[names[k]])]).first()
        for k in wide:
            (lo, hi), less, here, between, last = ends[names[k]], *[counts[f"{w}{names[k]}"] for w in "laib"]
            r = k[1]
            if less <= r < less + here:
                out[k] = lo
            elif less + here <= r < less + here + between:
                at[k] = (lo, hi, less + here, between)
            elif less + here + between <= r < less + here + between + last:
                out[k] = hi
            else:
                raise RuntimeError("a rank left its bracket")  # the sketch's bound rules it out
    left = [k for k in keys if k not in out]
    if left:
        own = {c: reduce(lambda p, q: p | q, [(F.col(c) > at[k][0]) & (F.col(c) < at[k][1]) for k in left if k[0] == c]) for c in dict.fromkeys(k[0] for k in left)}
        cells = F.array_compact(F.array(*[F.when(near, F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))) for c, near in own.items()]))
        values = sorted(map(tuple, rows.select(F.explode(cells).alias("s")).groupBy("s.c", "s.v").count().collect()))  # HELD for each rank
        for k in left:
            lo, hi, seen, _ = at[k]
            for c, v, times in values:
                if c == k[0] and lo < v < hi:
                    seen += times
                    if seen > k[1]:
                        out[k] = v
                        break
    return out


def percentiles_of(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float] | None]:
    """Exact percentiles of several columns by linear interpolation, null for a column without known values. Fitted at once."""
    rows = checkpointed(df.select(*[F.col(c).cast("double").alias(c) for c in shares]))
    n = rows.agg(*[F.count(c).alias(c) for c in shares]).first().asDict()
    places = {c: [p * (n[c] - 1) for p in ps] for c, ps in shares.items() if n[c]}
    at = order_statistics(rows, {c: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))}) for c, ps in places.items()}, n)
    value = lambda c, p: float(at[c, math.floor(p)] + (p - math.floor(p)) * (at[c, math.ceil(p)] - at[c, math.floor(p)]))
    return {c: [value(c, p) for p in places[c]] if n[c] else None for c in shares}


def percentiles(df: DataFrame, col: str, shares: list[float], where: Column | None = None) -> DataFrame:
    """One row (q array): exact percentiles by linear interpolation, null without known values. Fitted at once."""
    found = percentiles_of(df if where is None else df.filter(where), {col: shares})[col]
    return df.sparkSession.range(1).select(F.lit(found).cast("array<double>").alias("q"))


def median(df: DataFrame, col: str) -> DataFrame:
    """One row (med)."""
    return percentiles(df, col, [0.5]).select(F.col("q")[0].alias("med"))


def rescaled(df: DataFrame, col: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with <col>_01: clipped position between two percentiles."""
    q = percentiles(df, col, [low, high])
    x = (F.col(col) - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0] + EPS)
    return with_scalar(df, q).withColumn(f"{col}_01", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).drop("q")


def rank_table(df: DataFrame, col: str, out: str) -> DataFrame:
    """(_v, out): the average rank of each different value of col.

    Values are counted first, so one that many rows have is ordered once. Different values are dealt to sampled ranges,
    each summed up in a task of its own; the ranges' totals (one row each) give what lies before each. The ranged table is
    checkpointed, as a second look at its ranges could draw other bounds.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = checkpointed(counts.repartitionByRange(parts, "_v").withColumn("_c", F.spark_partition_id()))
    totals = cells.groupBy("_c").agg(F.sum("_n").alias("_t"))
    before = totals.select("_c", (F.sum("_t").over(Window.orderBy("_c")) - F.col("_t")).alias("_before"))  # one row for each range
    upto = F.sum("_n").over(Window.partitionBy("_c").orderBy("_v"))
    return cells.withColumn("_upto", upto).join(F.broadcast(before), "_c").select("_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the average rank of col, null where col is null."""
    return df.join(rank_table(df, col, out), F.col(col) == F.col("_v"), "left").drop("_v")


def _all_ranked(rows: DataFrame, cols: dict[str, str]) -> DataFrame:
    """rows (read more than once: checkpointed by the caller) with the average ranks of several columns."""
    out = rows
    for col, name in cols.items():
        out = out.join(rank_table(rows, col, name).withColumnRenamed("_v", col), col)
    return out


def positions(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with the dense position (from 0) of each row in a total order: ranges of rows, and counts of the ranges before.

    The ranged table is checkpointed, as a second look at its ranges could draw other bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_k", F.struct(*order)).repartitionByRange(parts, "_k").sortWithinPartitions("_k").drop("_k")
    # The high bits of the id are the range's number, the low 33 its row: positions need one count for each range.
    stored = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each range
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, at).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with columns that hold, for each row, the sums over all rows before it in a total order: within ranges, and of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_v_{c}": v for c, v in sums.items()}).withColumn("_k", F.struct(*order)).repartitionByRange(parts, "_k")
    kept = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    totals = kept.groupBy("_part").agg(*[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    own = Window.partitionBy("_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    within = kept.join(F.broadcast(before), "_part").withColumns({c: F.coalesce(F.sum(f"_v_{c}").over(own), F.lit(0)) + F.col(f"_b_{c}") for c in sums})
    return within.select(*df.columns, *sums)


def spearman(df: DataFrame, pairs: list[tuple[str, str]], least: int = 10) -> DataFrame:
    """(a, b, n, rho) for column pairs over rows where both are known; rho null where n <= least.

    Pairs over the same rows share one rank table for each column: all pairs of columns without nulls, and otherwise pairs
    whose rows lack the same columns.
    """
    names = sorted({c for p in pairs for c in p})
    df = checkpointed(df.select(*[F.col(c).cast("double").alias(c) for c in names]))
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for a, b in pairs:
        groups.setdefault(tuple(c for c in sorted({a, b}) if gaps[c]), []).append((a, b))
    out = []
    for holes, own in groups.items():
        cols = sorted({c for p in own for c in p})
        rows = df.select(*cols).na.drop(subset=list(holes)) if holes else df.select(*cols)
        ranked = _all_ranked(rows, {c: f"r_{c}" for c in cols})
        one = ranked.agg(F.count("*").alias("n"), *[F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in own])
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.when(F.col("n") > least, F.col(f"`{a}|{b}`")).alias("rho")) for a, b in own])).alias("s")
        out.append(one.select(each).select("s.*"))
    return reduce(DataFrame.unionByName, out)


def partial_spearman(df: DataFrame, x: str, y: str, controls: str | list[str], least: int = 30) -> DataFrame:
    """(n, rho): rank correlation of x and y with the ranks of any number of controls taken out of both; null where n < least.

    One pass gathers the correlations of all ranks; what the controls leave of x and y is their Schur complement, a matrix of
    two by two. Controls that determine each other count once.
    """
    names = [x, y, *([controls] if isinstance(controls, str) else controls)]
    rows = checkpointed(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]).na.drop())
    m = len(names)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    ranked = _all_ranked(rows, {f"_{i}": f"r{i}" for i in range(m)})
    got = ranked.agg(F.count("*").alias("n"), *[F.covar_pop(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((m, m))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"c{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(gram))
    gram /= np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    left = gram[:2, :2] - gram[:2, 2:] @ np.linalg.pinv(gram[2:, 2:], hermitian=True) @ gram[2:, :2]
    known = got["n"] >= least and min(left[0, 0], left[1, 1]) > 1e-12
    rho = float(left[0, 1] / np.sqrt(left[0, 0] * left[1, 1])) if known else None
    return df.sparkSession.createDataFrame([(got["n"], rho)], "n long, rho double")


def rank_bins(df: DataFrame, col: str, tie: str, bins: int, out: str) -> DataFrame:
    """Equal bins (1..bins) of the rank of col, ties by another column: bin = max(ceil((r - 1) * bins / (n - 1)), 1)."""
    known = df.filter(F.col(col).isNotNull())
    ranked = positions(known, [col, tie], "_r")
    value = F.greatest(F.ceil(F.col("_r") * bins / F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(1)).cast("int")
    return with_scalar(ranked, ranked.agg(F.count("*").alias("_n"))).withColumn(out, value).drop("_r", "_n")


def least_squares(df: DataFrame, y: str, cols: list[str]) -> list[tuple[str, float]]:
    """Coefficients of y on standardised columns (sample deviation) with an intercept, over rows that are finite in all.

    The columns are written once; one pass gathers means and covariances, and the driver solves a system as wide as cols. A
    column without spread has 0.
    """
    check(cols)
    names = [*cols, y]
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in names]
    rows = checkpointed(df.filter(reduce(lambda a, b: a & b, finite)).select(*[F.col(c).cast("double").alias(c) for c in names]))
    got = rows.agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n = len(names)
    cov = np.array([[got[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    scale = np.sqrt(np.diag(cov))[:-1] + EPS
    beta = np.linalg.lstsq(cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, rcond=None)[0]
    return list(zip(cols, map(float, beta), strict=True))


def fit_quality(df: DataFrame, y: str, out: str) -> DataFrame:
    """(n, r2, mae, rho) over all predictions together, rho their rank correlation with the truth."""
    df = checkpointed(df.select(F.col(y).cast("double").alias("_y"), F.col(out).cast("double").alias("_f")))
    e = F.col("_y") - F.col("_f")
    x = with_scalar(df, df.agg(F.avg("_y").alias("_m")))
    one = x.agg(F.count("*").alias("n"), (1 - F.sum(e * e) / F.sum(F.pow(F.col("_y") - F.col("_m"), 2))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    return with_scalar(one, spearman(df, [("_y", "_f")]).select("rho"))


def bradley_terry(pairs: DataFrame, cols: list[str], strength: float = 1.0) -> dict[str, float]:
    """Weights of a logistic model without intercept on winner-minus-loser differences, each pair in both directions."""
    return dict(zip(cols, map(float, bradley_terry_fits(pairs, cols, strength=strength)[0]), strict=True))


def bradley_terry_fits(pairs: DataFrame, cols: list[str], key: str | None = None, fits: int = 1, seed: int = 3, strength: float = 1.0) -> np.ndarray:
    """(fits, len(cols)) weights, all fitted together: Newton steps on log-likelihood minus |w|^2 / (2 strength).

    With a key, fit k counts a pair as often as a Poisson(1) draw from the hash of (key, seed, k) says. A pair in both
    directions is twice its likelihood. A step is one pass: each task adds up gradients and Hessians of all fits, and the
    driver gets fits x (d + d * d) numbers.
    """
    check(cols)
    importable(pairs.sparkSession)
    d = len(cols)
    rows = checkpointed(pairs.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.xxhash64(F.col(key) if key else F.lit(0), F.lit(seed)).alias("_h")).na.drop())
    w = np.zeros((fits, d))
    for _ in range(50):
        now = w

        def run(batches):
            total = np.zeros((fits, d + d * d))
            for b in batches:
                x = np.stack([b.column(i).to_numpy() for i in range(d)], 1)
                for at in range(0, len(x), 4096):
                    xs, h = x[at : at + 4096], b.column(d).to_numpy()[at : at + 4096]
                    p = 1 / (1 + np.exp(-np.clip(xs @ now.T, -500, 500)))
                    times = poisson_draws(h, fits) if key else np.ones_like(p)
                    total[:, :d] += (times * (1 - p)).T @ xs
                    total[:, d:] += (times * p * (1 - p)).T @ (xs[:, :, None] * xs[:, None, :]).reshape(len(xs), -1)
            k = np.arange(fits, dtype=np.int32)
            yield pa.record_batch([pa.array(k), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(d + d * d)]], ["fit", *[f"g{j}" for j in range(d + d * d)]])

        sums = rows.mapInArrow(run, "fit int, " + ", ".join(f"g{j} double" for j in range(d + d * d))).groupBy("fit").agg(*[F.sum(f"g{j}") for j in range(d + d * d)])
        got = np.zeros((fits, d + d * d))
        for r in sums.collect():
            got[r[0]] = r[1:]
        gradient = 2 * got[:, :d] - now / strength
        step = np.linalg.solve(2 * got[:, d:].reshape(fits, d, d) + np.eye(d) / strength, gradient[:, :, None])[:, :, 0]
        w = now + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def poisson_draws(h: np.ndarray, fits: int) -> np.ndarray:
    """(len(h), fits) Poisson(1) draws, each from a mix of a 64-bit hash and the fit's number."""
    z = h.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, fits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (z ^ (z >> np.uint64(31))) / 2.0**64
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), u, "right").astype(np.float64)


def bootstrap_interval(pairs: DataFrame, cols: list[str], key: str, rounds: int = 300, seed: int = 3) -> DataFrame:
    """(feature, low, high): 2.5 and 97.5 percentiles of refitted weights; a pair's multiplicity is drawn from its key's hash."""
    w = bradley_terry_fits(pairs, cols, key, rounds, seed)
    low, high = np.percentile(w, [2.5, 97.5], axis=0)
    return pairs.sparkSession.createDataFrame([(c, float(a), float(b)) for c, a, b in zip(cols, low, high, strict=True)], "feature string, low double, high double")


def mean_intervals(rows: DataFrame, cols: list[str], key: str, draws: int = 1000, seed: int = 5) -> DataFrame:
    """(model, n, agreement, low, high): means of cols with 2.5 and 97.5 percentiles of resampled means, and those of the
    differences of the first column's mean from the others' (model "first - other"), over the same draws and rows."""
    importable(rows.sparkSession)
    d = len(cols)
    flat = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))

    def run(batches):
        total = np.zeros((draws + 1, d + 1))
        for b in batches:
            x = np.stack([*(b.column(i).to_numpy() for i in range(d)), np.ones(b.num_rows)], 1)
            for at in range(0, len(x), 4096):
                times = poisson_draws(b.column(d).to_numpy()[at : at + 4096], draws)
                total[:draws] += times.T @ x[at : at + 4096]
                total[draws] += x[at : at + 4096].sum(0)
        yield pa.record_batch([pa.array(np.arange(draws + 1, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(d + 1)]], ["draw", *[f"s{j}" for j in range(d + 1)]])

    sums = flat.mapInArrow(run, "draw int, " + ", ".join(f"s{j} double" for j in range(d + 1))).groupBy("draw").agg(*[F.sum(f"s{j}") for j in range(d + 1)])
    got = np.zeros((draws + 1, d + 1))
    for r in sums.collect():
        got[r[0]] = r[1:]
    means = got[:, :d] / np.maximum(got[:, d:], 1)
    names = {c: means[:, i] for i, c in enumerate(cols)} | {f"{cols[0]} - {c}": means[:, 0] - means[:, i] for i, c in enumerate(cols) if i}
    out = [(m, int(got[draws, d]), float(v[draws]), *map(float, np.percentile(v[:draws], [2.5, 97.5]))) for m, v in names.items()]
    return rows.sparkSession.createDataFrame(out, "model string, n long, agreement double, low double, high double")


def agreement(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(n, agreement): share of pairs whose winner scores higher; a zero margin is wrong."""
    margin = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return pairs.agg(F.count("*").alias("n"), F.avg((margin > 0).cast("double")).alias("agreement"))
