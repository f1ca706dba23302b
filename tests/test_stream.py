"""The vote log as a stream: late votes, restarts, and state that shrinks."""

import datetime as dt

from pavewise.streaming import votes as stream

DAY = dt.datetime(2024, 5, 1)


def at(days, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def put(spark, path, rows):
    spark.createDataFrame(rows, stream.LOG).coalesce(1).write.mode("append").parquet(path)


def test_late_votes_count_in_the_table(spark, tmp_path):
    path, table, checkpoint, packed = (str(tmp_path / n) for n in ("votes", "last", "cp", "packed"))
    put(spark, path, [(at(0), "a", 1, "L"), (at(1), "b", 1, "L")])
    put(spark, path, [(at(90), "a", 2, "R")])
    stream.start(spark, path, table, checkpoint, files=1).awaitTermination(120)
    put(spark, path, [(at(0, 5), "a", 1, "R"), (at(0), "b", 1, "R")])  # three months late; the second is older than b's last
    stream.start(spark, path, table, checkpoint, files=1).awaitTermination(120)
    want = [("a", 1, "R"), ("a", 2, "R"), ("b", 1, "L")]
    assert sorted((r["rater"], r["pair_id"], r["choice"]) for r in stream.read(spark, table).collect()) == want
    stream.compact(spark, table, packed)
    assert sorted((r["rater"], r["pair_id"], r["choice"]) for r in stream.read(spark, packed).collect()) == want


def test_changes_forget_old_keys(spark, tmp_path):
    """State holds the keys of the last days alone; a vote that is too late is not given."""
    path, seen = str(tmp_path / "votes"), []
    steps = [
        [(at(0), "a", k, "L") for k in range(30)],
        [(at(0, 1), "a", 1, "R"), (at(0, -1), "a", 2, "R"), (at(0), "a", 3, "R")],
        [(at(20), "b", 1, "L")],
        [(at(40), "b", 2, "L")],
        [(at(1), "a", 5, "R"), (at(41), "b", 2, "tie")],
    ]
    sizes = []
    for rows in steps:
        put(spark, path, rows)
        got = []
        query = stream.changes(stream.stream(spark, path, 1), 168).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.collect())).start()
        query.awaitTermination(120)
        seen.append(sorted((r[0], r[1], r[3]) for r in got))
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    assert seen[0] == [("a", k, "L") for k in range(30)] and seen[1] == [("a", 1, "R"), ("a", 3, "R")]
    assert seen[2] == [("b", 1, "L")] and seen[3] == [("b", 2, "L")] and seen[4] == [("b", 2, "tie")]
    assert sizes[1] == 30 and sizes[3] <= 2 and sizes[4] <= 2
