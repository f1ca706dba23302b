"""Blind pairwise votes: winners, consensus, agreement, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(votes: DataFrame, keys: tuple[str, ...] = ("rater", "pair_id"), order: tuple[str, ...] = ("ts_iso", "event_id")) -> DataFrame:
    """One vote for each rater and pair: the last."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def winner(choice: Column, left: Column, right: Column) -> Column:
    return F.when(choice == "L", left).when(choice == "R", right)


def loser(choice: Column, left: Column, right: Column) -> Column:
    return F.when(choice == "L", right).when(choice == "R", left)


def decisive(votes: DataFrame) -> DataFrame:
    """Latest votes for a side, with winner_seg and loser_seg."""
    args = (F.col("choice"), F.col("seg_left"), F.col("seg_right"))
    return latest(votes).filter(F.col("choice").isin("L", "R")).withColumns({"winner_seg": winner(*args), "loser_seg": loser(*args)})


def consensus(decided: DataFrame) -> DataFrame:
    """(pair_id, consensus_winner_seg, n_raters, top_votes, agreement_frac, confidence_tier) of pairs with two votes at least.

    Equal counts go to the segment that the alphabetically first rater named.
    """
    per = decided.groupBy("pair_id", "winner_seg").agg(F.count("*").alias("n"), F.min("rater").alias("first"))
    w = Window.partitionBy("pair_id")
    top = per.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "first")), "all": F.sum("n").over(w)}).filter("r = 1 and all >= 2")
    share = F.col("n") / F.col("all")
    tier = F.when(share == 1, "unanimous").when(share >= 0.7, "strong").otherwise("split")
    return top.select("pair_id", F.col("winner_seg").alias("consensus_winner_seg"), F.col("all").alias("n_raters"), F.col("n").alias("top_votes"), share.alias("agreement_frac"), tier.alias("confidence_tier"))


def rater_agreement(decided: DataFrame, least: int = 10) -> DataFrame:
    """(a, b, n, agreement, kappa, underpowered) of raters on pairs that both decided."""
    x, y = decided.select("pair_id", F.col("rater").alias("a"), F.col("winner_seg").alias("wa")), decided.select("pair_id", F.col("rater").alias("b"), F.col("winner_seg").alias("wb"))
    both = x.join(y, "pair_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("wa") == F.col("wb")).cast("double")).alias("agreement"))
    return both.withColumns({"kappa": (F.col("agreement") - 0.5) / 0.5, "underpowered": F.col("n") < least})


def win_rate(decided: DataFrame) -> DataFrame:
    """(seg_id, wins, shown, rate)."""
    sides = F.explode(F.array(F.struct(F.col("winner_seg").alias("seg_id"), F.lit(1).alias("won")), F.struct(F.col("loser_seg").alias("seg_id"), F.lit(0).alias("won")))).alias("s")
    return decided.select(sides).groupBy("s.seg_id").agg(F.sum("s.won").alias("wins"), F.count("*").alias("shown")).withColumn("rate", F.col("wins") / F.col("shown"))


def differences(decided: DataFrame, z: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Decided pairs with d_<col> = winner's minus loser's value; pairs with an unknown segment go, or are an error if strict."""
    w = z.select(F.col("seg_id").alias("winner_seg"), *[F.col(c).alias(f"w_{c}") for c in cols])
    l = z.select(F.col("seg_id").alias("loser_seg"), *[F.col(c).alias(f"l_{c}") for c in cols])
    if strict:
        known = lambda side, c: F.when(F.col(side).isNull(), F.raise_error(F.concat(F.lit("unknown segment "), F.col(c).cast("string")))).otherwise(F.col(c))
        w, l = w.withColumn("_w", F.lit(1)), l.withColumn("_l", F.lit(1))
        both = decided.join(w, "winner_seg", "left").join(l, "loser_seg", "left")
        both = both.withColumns({"winner_seg": known("_w", "winner_seg"), "loser_seg": known("_l", "loser_seg")}).filter("winner_seg is not null and loser_seg is not null").drop("_w", "_l")
    else:
        both = decided.join(w, "winner_seg").join(l, "loser_seg")
    return both.withColumns({f"d_{c}": F.col(f"w_{c}") - F.col(f"l_{c}") for c in cols})


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def one_per_cell(pool: DataFrame, group: str, cell: str, order: list[Column], most: int) -> DataFrame:
    """Up to ``most`` rows of each group: first the best of each cell, then the rest in order."""
    first = F.row_number().over(Window.partitionBy(group, cell).orderBy(*order))
    ranked = pool.withColumn("_first", first)
    place = F.row_number().over(Window.partitionBy(group).orderBy((F.col("_first") > 1).cast("int"), *order))
    return ranked.withColumn("place", place).filter(F.col("place") <= most).drop("_first")
