"""Column expressions, geometry, joins against brute force, statistics, votes, graphs, sources."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pavewise import guard
from pavewise.functions import expr as X
from pavewise.operators import geo, graph, stats, votes
from pavewise.sources import files, paged
from pavewise.streaming import votes as stream
from pyspark.sql import functions as F


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_tags(spark):
    got = one(spark, X.first_of(F.array(F.lit("a"), F.lit("b"))), X.first_of(F.lit(None).cast("array<string>")), X.joined(F.array(F.lit("a"), F.lit("b"))), X.category(F.lit('{"primary":"Bar"}')), X.category(F.lit("no")), X.at_night(F.lit("barber")))
    assert got == ["a", "", "a, b", "bar", "", True]
    cls = F.lit(2)
    assert one(spark, X.first_number(F.lit("30;35 mph"), cls, X.DEFAULT_MPH, 25), X.first_number(F.lit("signals"), cls, X.DEFAULT_MPH, 25), X.first_number(F.lit(None).cast("string"), F.lit(0), X.DEFAULT_LANES, 2)) == [30.0, 25.0, 2.0]
    assert one(spark, X.sidewalk(F.lit("primary"), F.lit("Separate")), X.sidewalk(F.lit("primary"), F.lit("no")), X.sidewalk(F.lit("path"), F.lit("no")), X.sidewalk(F.lit("primary"), F.lit(None).cast("string"))) == [1.0, 0.0, 1.0, 0.5]


def test_day_safety(spark):
    got = one(spark, X.day_safety(F.lit(1), F.lit(25.0), F.lit(2.0), F.lit(1.0)), X.day_safety(F.lit(0), F.lit(35.0), F.lit(2.0), F.lit(1.0)), X.day_safety(F.lit(None).cast("int"), F.lit(35.0), F.lit(2.0), F.lit(1.0)))
    assert got == [0.92, 0.75, None]


def test_clock_answer_names(spark):
    assert one(spark, X.gtfs_hour(F.lit("25:10:00")), X.gtfs_hour(F.lit("x:1")), X.octant(F.lit(-1.0)), X.leaf_on(F.lit(None).cast("int"))) == [25, None, 7, False]
    assert one(spark, X.answer(F.lit("I say left.")), X.answer(F.lit("same")), X.answer(F.lit("?")), X.rater_name(F.lit(" a;b<c> "))) == ["L", "tie", "skip", "abc"]
    assert one(spark, X.tier(F.lit(1.0)), X.tier(F.lit(0.7)), X.tier(F.lit(0.6)), X.bias_flag(F.lit(-0.5))) == ["unanimous", "strong", "split", "WATCH"]


def test_utm(spark):
    """Central meridian: easting 500 km, and the meridian arc to 45 degrees times the scale."""
    east, north = X.utm(F.lit(-117.0), F.lit(45.0), 11)
    e, n = one(spark, east, north)
    assert abs(e - 500000) < 1e-6 and abs(n - 0.9996 * 4984944.378) < 0.01
    assert one(spark, X.utm_epsg(F.lit(-116.2), F.lit(43.6)), X.utm_epsg(F.lit(151.0), F.lit(-33.0))) == [32611, 32756]


def test_geometry(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 3.0, 3.0))), F.array(*map(F.lit, (0.0, 0.0, 4.0)))
    assert one(spark, geo.line_length(xs, ys)) == [7.0]
    assert tuple(one(spark, geo.point_along(xs, ys, F.lit(5.0)))[0]) == (3.0, 2.0)
    assert tuple(one(spark, geo.point_along(xs, ys, F.lit(99.0)))[0]) == (3.0, 4.0)
    rx, ry = F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0, 0.0)))
    assert one(spark, geo.ring_area(rx, ry), geo.in_ring(F.lit(1.0), F.lit(1.0), rx, ry), geo.in_ring(F.lit(5.0), F.lit(1.0), rx, ry)) == [12.0, True, False]


def test_sample_points(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 30.0), (2, 0.0, 0.0, 0.0, 1.0, 5.0), (3, 1.0, 1.0, 1.0, 0.0, 0.0)], "seg_id long, x1 double, y1 double, ux double, uy double, length_m double")
    got = {}
    for r in geo.sample_points(s, 12.0).collect():
        got.setdefault(r["seg_id"], []).append((r["lx"], r["ly"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 0), (12, 0), (24, 0)], 2: [(0, 0), (0, 5)], 3: [(1, 1)]}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.floats(1.0, 60.0))
def test_near_is_brute_force(spark, seed, radius):
    rng = random.Random(seed)
    a = [(i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(40)]
    b = [(i, rng.choice([rng.uniform(-100, 100), radius]), rng.uniform(-100, 100)) for i in range(40)]
    got = geo.near(spark.createDataFrame(a, "i long, lx double, ly double"), spark.createDataFrame(b, "j long, rx double, ry double"), radius)
    want = {(i, j) for i, x, y in a for j, u, v in b if math.sqrt((u - x) ** 2 + (v - y) ** 2) <= radius}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nearest_point_ties_and_far(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "k long, lx double, ly double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (5, 5.0, 0.0), (9, 0.0, -90.0)], "id long, rx double, ry double")
    got = {r["k"]: (r["id"], r["d"]) for r in geo.nearest_point(left, right, "k", "id", 10.0).collect()}
    assert got == {1: (5, 5.0), 2: (5, 4995.0)}


def test_ranks_and_bins(spark):
    values = [3, 1, 3, None, 2, 3, 1, 9]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int")
    got = {r["id"]: r["r"] for r in stats.average_ranks(df, "v", "r").collect()}
    want = pd.Series(values, dtype="float").rank()
    assert all(got[i] is None if np.isnan(w) else got[i] == w for i, w in enumerate(want))
    for n in (4, 5, 10, 23):
        rows = spark.createDataFrame([(i, float(i * 7 % n)) for i in range(n)], "id long, v double")
        b = {r["v"]: r["b"] for r in stats.rank_bins(rows, "v", "id", 4, "b").collect()}
        q = pd.qcut(pd.Series(range(n)).rank(method="first"), 4, labels=False) + 1
        assert [b[float(v)] for v in range(n)] == list(q)


def test_blocks_do_not_change_routes(spark):
    """Random graphs with many equal lengths: labels are the same with any blocks, and distances those of Bellman-Ford."""
    rng = random.Random(5)
    edges = [(k, rng.randrange(40), rng.randrange(40), float(rng.choice((14, 28, 42))), 0.5) for k in range(90)]
    df = graph.costs(spark.createDataFrame([e for e in edges if e[1] != e[2]], "edge_id long, u long, v long, length_m double, comfort double"))
    labels = [sorted(map(tuple, graph.distances(df, ["cost_fast"], 0, block=lambda n, b=b: F.pmod(n, F.lit(b))).collect())) for b in (1, 3, 7)]
    assert labels[0] == labels[1] == labels[2]
    best = {0: 0.0}
    for _ in range(40):
        for _, u, v, m, _ in edges:
            for a, b in ((u, v), (v, u)):
                if a in best and u != v:
                    best[b] = min(best.get(b, 1e9), best[a] + m / 1.4)
    assert {r[1]: round(r[2], 6) for r in labels[0]} == {n: round(d, 6) for n, d in best.items()}


def test_percentiles_narrow_their_brackets(spark, monkeypatch):
    monkeypatch.setattr(stats, "HELD", 20)
    monkeypatch.setattr(stats, "SKETCH", 50)
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=3000), rng.integers(0, 3, 3000).astype(float), np.r_[np.zeros(2000), rng.random(999)], np.array([4.0])):
        shares = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
        got = stats.percentiles(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", shares).first()["q"]
        assert np.allclose(got, np.quantile(x, shares), rtol=0, atol=1e-12)


def test_all_refits_together_are_each_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, p double, q double")
    h = np.array([r[0] for r in df.select(F.xxhash64("k", F.lit(3))).collect()])
    times = stats.poisson_draws(h, 3)
    assert abs(stats.poisson_draws(np.arange(20_000), 5).mean() - 1) < 0.02
    d = np.array([r[1:] for r in rows])
    for w, t in zip(stats.bradley_terry_fits(df, ["p", "q"], "k", 3), times.T, strict=True):
        assert np.abs(2 * (t[:, None] * d / (1 + np.exp(d @ w))[:, None]).sum(0) - w).max() < 1e-8


def test_polygons_and_lines(spark):
    square = ([0.0, 10.0, 10.0, 0.0, 0.0], [0.0, 0.0, 10.0, 10.0, 0.0])
    hole = ([4.0, 6.0, 6.0, 4.0, 4.0], [4.0, 4.0, 6.0, 6.0, 4.0])
    df = spark.createDataFrame([(1, [square, hole])], "id long, rings array<struct<xs:array<double>,ys:array<double>>>")
    assert df.select(geo.polygon_area(F.col("rings"))).first()[0] == 96
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 4.0, 5.0), (5, 13.0, 14.0), (6, 40.0, 0.0)], "k long, lx double, ly double")
    assert {r["k"] for r in geo.near_polygons(pts, df, 0.0, 7.0, ("id",)).collect()} == {1}
    assert {r["k"]: r["d"] for r in geo.near_polygons(pts, df, 5.0, 7.0, ("id",)).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 5}
    bent = spark.createDataFrame([(1, [0.0, 3.0, 3.0], [0.0, 0.0, 9.0]), (2, [1.0], [1.0]), (3, [], []), (4, [2.0, 2.0], [5.0, 5.0])], "seg_id long, xs array<double>, ys array<double>")
    got: dict = {}
    for r in geo.sample_line(bent, 5.0).collect():
        got.setdefault(r["seg_id"], []).append((r["lx"], r["ly"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 0), (3, 2), (3, 7)], 2: [(1, 1)], 4: [(2, 5)]}
    x, y = F.col("xs"), F.col("ys")
    c = {r[0]: r[1] for r in bent.filter("size(xs) > 0").select("seg_id", geo.line_centroid(x, y).alias("c")).collect()}
    assert (c[1]["x"], c[1]["y"]) == (2.625, 3.375) and (c[2]["x"], c[4]["y"]) == (1, 5)
    d = {r[0]: r[1] for r in bent.select("seg_id", geo.distance_to_line(F.lit(5.0), F.lit(-1.0), x, y)).collect()}
    assert d[1] == math.sqrt(5) and d[2] == math.sqrt(20) and d[3] is None


def test_zscores_and_rescale(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 5, 7)], "v double")
    for ddof in (0, 1):
        got = sorted(r[0] for r in stats.zscore(df, ["v"], ddof).select("z_v").collect())
        x = np.array([1, 2, 2, 5, 7.0])
        assert np.allclose(got, (x - x.mean()) / (x.std(ddof=ddof) + 1e-9))
    assert {r[0] for r in stats.rescaled(df, "v").select("v_01").collect()} >= {0.0, 1.0}


def test_spearman_guards(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i * i)) for i in range(40)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["rho"] for r in stats.spearman(df, [("a", "b"), ("a", "c")]).collect()}
    p = df.toPandas()
    assert abs(got[("a", "b")] - p["a"].rank().corr(p["b"].rank())) < 1e-12 and abs(got[("a", "c")] - 1) < 1e-12
    assert stats.spearman(df.limit(10), [("a", "b")]).first()["rho"] is None
    assert stats.partial_spearman(df.limit(20), "a", "b", "c").first()["rho"] is None


def test_bradley_terry_optimum_and_planted_signs(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(300, 2))
    win = rng.random(300) < 1 / (1 + np.exp(-(1.5 * d[:, 0] - 0.7 * d[:, 1])))
    d[~win] *= -1
    w = stats.bradley_terry(spark.createDataFrame(d.tolist(), "p double, q double"), ["p", "q"])
    v = np.array([w["p"], w["q"]])
    grad = v - 2 * (d.T @ (1 / (1 + np.exp(d @ v))))
    assert np.abs(grad).max() < 1e-2 and w["p"] > 1 and w["q"] < -0.3


def test_guard():
    assert guard.check(["light"]) == ["light"]
    for bad in ("crime_100m", "Income", "pct_nonwhite"):
        with pytest.raises(ValueError):
            guard.check(["light", bad])


def test_consensus_ties(spark):
    rows = [("r1", 1, 10), ("r2", 1, 20), ("r3", 2, 10), ("r1", 3, 5), ("r2", 3, 5), ("r3", 3, 6)]
    got = {r["pair_id"]: (r["consensus_winner_seg"], r["n_raters"], r["confidence_tier"]) for r in votes.consensus(spark.createDataFrame(rows, "rater string, pair_id long, winner_seg long")).collect()}
    assert got == {1: (10, 2, "split"), 3: (5, 3, "split")}


def test_differences_strict(spark):
    decided = spark.createDataFrame([(1, 10, 20), (2, 10, 99)], "pair_id long, winner_seg long, loser_seg long")
    z = spark.createDataFrame([(10, 3.0), (20, 1.0)], "seg_id long, v double")
    assert [(r["pair_id"], r["d_v"]) for r in votes.differences(decided, z, ["v"]).collect()] == [(1, 2.0)]
    with pytest.raises(Exception, match="unknown segment 99"):
        votes.differences(decided, z, ["v"], strict=True).collect()
    assert votes.differences(decided.filter("pair_id = 1"), z, ["v"], strict=True).first()["d_v"] == 2.0


def test_one_per_cell(spark):
    rows = [(1, "g", "x"), (2, "g", "x"), (3, "g", "y"), (4, "g", "x")]
    got = votes.one_per_cell(spark.createDataFrame(rows, "id long, grp string, cell string"), "grp", "cell", [F.col("id")], 3)
    assert [r["id"] for r in got.orderBy("place").collect()] == [1, 3, 2]


def test_routes(spark):
    edges = spark.createDataFrame([(1, 0, 1, 14.0, 0.0), (2, 1, 2, 14.0, 0.0), (3, 0, 2, 35.0, 1.0), (4, 0, 1, 99.0, 0.0), (5, 8, 9, 1.0, 0.5)], "edge_id long, u long, v long, length_m double, comfort double")
    c = graph.costs(edges)
    for block in (4096, 1, 2):
        both = graph.distances(c, ["cost_fast", "cost_calm"], 0, block=lambda node, b=block: F.floor(node / b))
        assert {r["node"]: round(r["dist"], 6) for r in both.collect() if r["kind"] == "cost_fast"} == {0: 0, 1: 10, 2: 20}
        assert sorted((r["kind"], r["edge_id"]) for r in graph.path(both, 2).collect()) == [("cost_calm", 3), ("cost_fast", 1), ("cost_fast", 2)]
    assert dict(graph.components(edges).collect()) == {0: 0, 1: 0, 2: 0, 8: 8, 9: 8}


def test_paged_source(spark, tmp_path):
    feature = lambda i: {"geometry": {"x": i * 1.0, "y": 2.0}, "attributes": {"Wattage": i}}
    (tmp_path / "count.json").write_text('{"count": 5}')
    for off in (0, 2, 4):
        (tmp_path / f"{off}.json").write_text(json.dumps({"features": [feature(i) for i in range(off, min(off + 2, 5))]}))
    paged.register(spark)
    df = spark.read.format("paged_features").option("url", str(tmp_path)).option("page", "2").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r[0] for r in df.select(F.get_json_object("attributes", "$.Wattage").cast("int")).collect()) == [0, 1, 2, 3, 4]


def test_paged_source_short_pages_and_statistics(spark, tmp_path):
    """A service whose pages are shorter than asked for loses no row; one that stops early is an error."""
    feature = lambda i: {"geometry": {"x": i * 1.0, "y": 2.0}, "attributes": {"Wattage": i}}
    (tmp_path / "count.json").write_text('{"count": 5}')
    for off, n in ((0, 2), (2, 1), (3, 1), (4, 1)):
        (tmp_path / f"{off}.json").write_text(json.dumps({"features": [feature(i) for i in range(off, off + n)]}))
    (tmp_path / "groups.json").write_text('{"features": [{"attributes": {"kind": "led", "n": 4}}]}')
    (tmp_path / "fields.json").write_text('{"fields": [{"name": "kind", "type": "text"}]}')
    paged.register(spark)
    read = lambda: spark.read.format("paged_features").option("url", str(tmp_path)).option("page", "3").load()
    assert sorted(r["lon"] for r in read().collect()) == [0, 1, 2, 3, 4]
    assert paged.group_count({"url": str(tmp_path)}, "kind") == {"led": 4} and paged.fields({"url": str(tmp_path)}) == [("kind", "text")]
    (tmp_path / "4.json").write_text('{"features": []}')
    with pytest.raises(Exception, match="1 of 2 rows at 3"):
        read().collect()
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    assert paged.narrowed("-10,-20,30,40", [GreaterThan(("lon",), 5), LessThanOrEqual(("lat",), 7.0), GreaterThan(("other",), 1)]) == "5.0,-20.0,30.0,7.0"
    assert paged.narrowed(None, []) is None


def test_release_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (1, 3.5, "b"), (2, 0.12345, None)], "id long, v double, s string")
    assert sorted(map(tuple, files.latest(df, "id", "v").collect())) == [(1, 3.5, "b"), (2, 0.12345, None)]
    assert sorted(map(tuple, files.released(df, ["v", "none", "id"], 0).collect())) == [(0.0, 2), (2.0, 1), (4.0, 1)]
    built = []
    make = lambda: built.append(1) or df
    for rebuild in (False, False, True):
        assert files.kept(spark, str(tmp_path / "k"), make, rebuild).count() == 3
    assert len(built) == 2 and files.first_of(spark, [str(tmp_path / "2022"), str(tmp_path / "k")]).endswith("k")
    files.write_report(df.filter("id = 2"), str(tmp_path / "r"))
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "r")).first()["v"] == 0.12345 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "r2"))
    with pytest.raises(Exception, match="missing"):
        files.append_log(df.withColumn("missing", F.lit(1)), str(tmp_path / "k"), ["missing"])


def test_well_known_binary(spark):
    import struct

    point = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    line = struct.pack(">BII4d", 0, 2, 2, 0.0, 1.0, 2.0, 3.0)
    ring = struct.pack("<I8d", 4, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0)
    polygon = struct.pack("<BII", 1, 3, 2) + ring + ring
    rows = spark.createDataFrame([(1, point), (2, line), (3, polygon), (4, None)], "id long, wkb binary")
    got = {r["id"]: r["g"] for r in rows.select("id", files.wkb_vertices(F.col("wkb")).alias("g")).collect()}
    assert (got[1][0]["xs"], got[1][0]["ys"]) == ([3.0], [4.0]) and got[2][0]["xs"] == [0.0, 2.0] and len(got[3]) == 2 and got[4] is None


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("departure_time,stop_id,extra\n25:00:00,a,1\n")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "t.csv"), "stop_times").collect()] == [("a", "25:00:00")]
    with pytest.raises(ValueError):
        files.csv(spark, str(tmp_path / "t.csv"), "stops")
    (tmp_path / "acs.json").write_text('[["GEOID","B"],["01","5"],["02",null]]')
    assert [tuple(r) for r in files.header_table(spark, str(tmp_path / "acs.json")).collect()] == [("01", "5"), ("02", None)]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1)], "rater string, pair_id long")
    assert files.append_log(rows, log, ["rater", "pair_id"]) == 2 and files.append_log(rows, log, ["rater", "pair_id"]) == 0
    assert files.image_grid(0, 0, 1, 1, 12, spark).count() == 144
    seg = spark.createDataFrame([(1, [0.0, 1.0], [2.0, 3.0])], "seg_id long, xs array<double>, ys array<double>")
    files.geojson_lines(seg.select("seg_id", "xs", "ys"), str(tmp_path / "g"), "", F.col("xs"), F.col("ys"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["geometry"]["coordinates"] == [[0.0, 2.0], [1.0, 3.0]]


def test_vote_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 8)
    at = lambda h: t0 + dt.timedelta(hours=h)
    path, table, checkpoint = (str(tmp_path / n) for n in ("votes", "last", "cp"))
    first = [(at(0), "a", 1, "L"), (at(2), "a", 1, "R"), (at(1), "b", 1, "R")]
    spark.createDataFrame(first, stream.LOG).coalesce(1).write.parquet(path)
    stream.start(spark, path, table, checkpoint).awaitTermination(120)
    assert sorted((r["rater"], r["pair_id"], r["choice"]) for r in stream.read(spark, table).collect()) == [("a", 1, "R"), ("b", 1, "R")]
    later = [(at(60), "a", 2, "tie"), (at(1), "a", 1, "L"), (at(70), "b", 1, "L")]
    spark.createDataFrame(later, stream.LOG).write.mode("append").parquet(path)
    stream.start(spark, path, table, checkpoint).awaitTermination(120)
    got = stream.read(spark, table)
    whole = spark.createDataFrame(first + later, stream.LOG)
    from pavewise.operators import votes

    batch = votes.latest(whole, order=("ts", "choice"))
    assert sorted(map(tuple, got.select("rater", "pair_id", "choice").collect())) == sorted(map(tuple, batch.select("rater", "pair_id", "choice").collect())) == [("a", 1, "R"), ("a", 2, "tie"), ("b", 1, "L")]
    assert sorted((r["rater"], r["n_l"], r["n_r"], r["n"]) for r in stream.tallies(got).collect()) == [("a", 0, 0, 1), ("a", 0, 1, 1), ("b", 1, 0, 1)]
