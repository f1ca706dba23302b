"""A vote log that grows: the last vote of each rater and pair and daily tallies, kept in durable tables.

As in batch (``operators.votes.latest``), the last vote counts, by time and then by choice. ``start`` holds no state: a micro-batch
writes the last votes among its own into a folder named by its number, overwritten if it is run again, so restarts neither
lose nor repeat votes, and a vote counts however late it comes; reading takes the last of each key over all folders, and ``compact``
puts many folders into one. ``changes`` is for those who follow the log: it gives each vote that replaces the one before, and
forgets a key after a time without votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "ts timestamp, rater string, pair_id long, choice string"
KEYS = ("rater", "pair_id")


def stream(spark: SparkSession, path: str, files: int = 50) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path)


def last_votes(votes: DataFrame) -> DataFrame:
    """One row for each rater and pair, the last."""
    return votes.groupBy(*KEYS).agg(F.max(F.struct("ts", "choice")).alias("v")).select(*KEYS, "v.*")


def tallies(votes: DataFrame, window: str = "1 day") -> DataFrame:
    """Votes by window and rater of a table of last votes."""
    c = F.col("choice")
    return votes.groupBy(F.window("ts", window), "rater").agg(F.count_if(c == "L").alias("n_l"), F.count_if(c == "R").alias("n_r"), F.count_if(c == "tie").alias("n_tie"), F.count("*").alias("n"))


def start(spark: SparkSession, path: str, table: str, checkpoint: str, files: int = 50) -> StreamingQuery:
    """Last votes of all files there are, into the folder table; ends when they are read, and goes on from there when started again."""

    def write(batch: DataFrame, number: int) -> None:
        last_votes(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream(spark, path, files).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def compact(spark: SparkSession, table: str, to: str) -> None:
    """The last votes of table as one folder of a new table; a stream that goes on there begins with the number after those of table."""
    read(spark, table).write.mode("overwrite").parquet(f"{to}/batch=-1")


def changes(votes: DataFrame, hours: int = 168) -> DataFrame:
    """(rater, pair_id, ts, choice) of a stream of votes, in update mode: each key's vote whenever it is later than the one before.

    A key is forgotten once the watermark (the latest time seen, less ``hours``) passes its last vote by as long, so state is
    bounded by the votes of twice that time. A vote older than the watermark is late: it is not given, as its key may have
    been forgotten; start counts it all the same.
    """
    milliseconds = hours * 3_600_000

    def last(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = max((r.ts, r.choice) for part in parts for r in part.itertuples())
        if state.exists and best <= (pd.Timestamp(state.get[0]), state.get[1]):
            best, new = (pd.Timestamp(state.get[0]), state.get[1]), False
        else:
            new = True
            state.update((best[0].to_pydatetime(), best[1]))
        at = int(best[0].tz_localize("UTC").timestamp() * 1000) if best[0].tzinfo is None else int(best[0].timestamp() * 1000)
        state.setTimeoutTimestamp(max(at + milliseconds, state.getCurrentWatermarkMs() + 1))
        if new:
            yield pd.DataFrame({"rater": [key[0]], "pair_id": [key[1]], "ts": [best[0]], "choice": [best[1]]})

    keyed = votes.withWatermark("ts", f"{hours} hours").groupBy(*KEYS)
    return keyed.applyInPandasWithState(last, "rater string, pair_id long, ts timestamp, choice string", "ts timestamp, choice string", "update", GroupStateTimeout.EventTimeTimeout)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The last votes that start has written so far."""
    return last_votes(spark.read.schema(LOG).parquet(f"{table}/batch=*"))
