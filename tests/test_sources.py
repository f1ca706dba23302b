"""Limited services, geometry files, header tables, transforms and small expressions."""

import json
import random
import struct

import numpy as np
import pytest
from pavewise.functions import expr as X
from pavewise.sources import files, paged
from pyspark.sql import functions as F


def service(path, points):
    path.mkdir()
    features = [{"geometry": {"x": x, "y": y}, "attributes": {"id": i, "kind": "k"}} for i, (x, y) in enumerate(points)]
    (path / "all.json").write_text(json.dumps({"features": features}))
    return {"url": str(path)}


def test_enumeration_loses_no_row(spark, tmp_path):
    """A service that gives 7 rows a call; a crowd in one corner, and points on the cells' shared edges."""
    rng = random.Random(1)
    points = [(rng.random() * 8, rng.random() * 8) for _ in range(150)] + [(0.1 + rng.random() / 50, 7.9 - rng.random() / 50) for _ in range(120)] + [(2.0, 2.0), (4.0, 4.0), (0.0, 0.0), (8.0, 8.0)]
    options = service(tmp_path / "s", points)
    got = paged.enumerated(spark, options, (0.0, 0.0, 8.0, 8.0), 7, "id", grid=2).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(len(points))) and not any(r["capped"] for r in got)
    assert all((r["lon"], r["lat"]) == points[int(r["id"])] for r in got)
    some = paged.enumerated(spark, options, (0.0, 0.0, 8.0, 8.0), 7, "id", grid=2, deepest=2, lossy=True).collect()
    assert len(some) < len(points) and {r["capped"] for r in some} == {True, False}
    with pytest.raises(RuntimeError, match="over 7 features"):
        paged.enumerated(spark, options, (0.0, 0.0, 8.0, 8.0), 7, "id", grid=2, deepest=2)
    assert paged.enumerated(spark, service(tmp_path / "none", []), (0.0, 0.0, 1.0, 1.0), 7, "id").count() == 0


def test_a_pushed_box_asks_for_the_count_again(spark, tmp_path):
    options = service(tmp_path / "s", [(float(i), 0.0) for i in range(10)])
    paged.register(spark)
    df = spark.read.format("paged_features").options(**options, page="2", total="10").load()
    assert df.count() == 10 and sorted(r["lon"] for r in df.filter("lon >= 6").collect()) == [6, 7, 8, 9]


def test_what_a_call_sends():
    page = {"resultOffset": 4, "resultRecordCount": 2}
    rows = paged.query_of({"dialect": "rows", "bbox": "1,2,3,4", "columns": "id,lon", "where": "a=1"}, page)
    assert rows == {"$where": "(a=1) AND lon >= 1 AND lon <= 3 AND lat >= 2 AND lat <= 4", "$order": ":id", "$limit": 2, "$offset": 4, "$select": "id,lon,lat"}
    assert paged.query_of({"dialect": "rows", "bbox": "1,2,3,4"}, {"returnCountOnly": "true"})["$where"].startswith("(1=1) AND lon >= 1")
    sent = paged.query_of({"bbox": "1,2,3,4", "columns": "id"}, page)
    assert sent["outFields"] == "id" and sent["geometry"] == "1,2,3,4" and sent["orderByFields"] == "OBJECTID"


def ring(xy, order="<", wide=2):
    return struct.pack(f"{order}I", len(xy)) + b"".join(struct.pack(f"{order}{wide}d", *p, *[9.0] * (wide - 2)) for p in xy)


def polygon(rings, order="<", kind=3, wide=2, srid=None):
    head = struct.pack(f"{order}BI", order == "<", kind | (0x20000000 if srid else 0)) + (struct.pack(f"{order}I", srid) if srid else b"")
    return head + struct.pack(f"{order}I", len(rings)) + b"".join(ring(r, order, wide) for r in rings)


SQUARE, HOLE, FAR = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)], [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]


def test_shapes_of_all_kinds(spark):
    many = struct.pack("<BII", 1, 6, 2) + polygon([SQUARE, HOLE]) + polygon([FAR], ">")
    cases = {
        1: (polygon([SQUARE]), [(0, SQUARE)]),
        2: (polygon([SQUARE, HOLE]), [(0, SQUARE), (0, HOLE)]),
        3: (many, [(0, SQUARE), (0, HOLE), (1, FAR)]),
        4: (polygon([SQUARE], kind=1003, wide=3), [(0, SQUARE)]),
        5: (polygon([SQUARE], kind=3 | 0x80000000, wide=3), [(0, SQUARE)]),
        6: (polygon([SQUARE], ">", kind=3003, wide=4), [(0, SQUARE)]),
        7: (polygon([FAR], srid=4326), [(0, FAR)]),
        8: (struct.pack("<BI2d", 1, 1, 3.0, 4.0), [(0, [(3.0, 4.0)])]),
        9: (struct.pack("<BII", 1, 4, 2) + struct.pack("<BI2d", 1, 1, 3.0, 4.0) + struct.pack(">BI2d", 0, 1, 5.0, 6.0), [(0, [(3.0, 4.0)]), (1, [(5.0, 6.0)])]),
        10: (struct.pack("<BI", 1, 2) + ring(SQUARE), [(0, SQUARE)]),
        11: (None, None),
    }
    df = spark.createDataFrame([(i, bytearray(b) if b else None) for i, (b, _) in cases.items()], "id long, wkb binary").repartition(2)
    got = {r["id"]: r["g"] for r in df.select("id", files.wkb_vertices(F.col("wkb")).alias("g")).collect()}
    for i, (_, want) in cases.items():
        assert (got[i] is None) == (want is None) and [(g["part"], list(zip(g["xs"], g["ys"], strict=True))) for g in got[i] or []] == (want or [])
    with pytest.raises(Exception, match="shape 7 is not read"):
        spark.createDataFrame([(bytearray(struct.pack("<BI", 1, 7)),)], "wkb binary").select(files.wkb_vertices(F.col("wkb"))).collect()


def test_boxes_reach_row_groups(spark, tmp_path):
    """Shapes are written and read back whole; a small box reads a part of the file's rows."""
    rng = random.Random(3)
    at = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(4000)]
    df = spark.createDataFrame([(i, bytearray(polygon([[(x + a, y + b) for a, b in SQUARE]]))) for i, (x, y) in enumerate(at)], "id long, wkb binary")
    shapes = files.with_box(df.withColumn("rings", files.wkb_vertices(F.col("wkb")))).drop("rings")
    files.write_shapes(shapes, str(tmp_path / "shapes"), 50.0, **{"parquet.block.size": "20000", "parquet.page.row.count.limit": "100"})
    assert {r["id"]: bytes(r["wkb"]) for r in spark.read.parquet(str(tmp_path / "shapes")).collect()} == {r["id"]: bytes(r["wkb"]) for r in df.collect()}
    some = files.shapes_in(spark, str(tmp_path / "shapes"), 100.0, 100.0, 140.0, 140.0)
    want = sorted(i for i, (x, y) in enumerate(at) if x <= 140 and x + 4 >= 100 and y <= 140 and y + 4 >= 100)
    assert sorted(r["id"] for r in some.collect()) == want and want
    plan = some._jdf.queryExecution().executedPlan()
    assert "bbox.xmin" in plan.toString().split("PushedFilters")[1]
    some.write.format("noop").mode("overwrite").save()
    import pyarrow.parquet as pq

    parts = [pq.ParquetFile(p).metadata for p in (tmp_path / "shapes").glob("*.parquet")]
    boxes = []
    for m in parts:
        for g in range(m.num_row_groups):
            group = m.row_group(g)
            ends = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            boxes.append((ends["bbox.xmin"].min <= 140 and ends["bbox.xmax"].max >= 100 and ends["bbox.ymin"].min <= 140 and ends["bbox.ymax"].max >= 100, group.num_rows))
    assert sum(n for hit, n in boxes if hit) < 1500 < sum(n for _, n in boxes) == 4000


@pytest.mark.parametrize("text", ['[["NAME","state","tract"],\n["A, \\"x\\"","16","000100"],\n["B","16",null]]', '[["NAME","state","tract"],["A, \\"x\\"","16","000100"],["B","16",null]]', '[["NAME","state","tract"],\n\n["A, \\"x\\"","16","000100"], ["B","16",null]\n]'.replace("\n]", "]")])
def test_header_tables(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    rows = files.header_table(spark, str(tmp_path / "t.json"))
    assert rows.columns == ["NAME", "state", "tract"] and sorted(map(tuple, rows.collect())) == [('A, "x"', "16", "000100"), ("B", "16", None)]


def test_utm_there_and_back(spark):
    """Both hemispheres, every zone, up to three degrees off the middle meridian: within a millimetre (and a 10,000,000th degree)."""
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 500), rng.uniform(-80, 84, 500), strict=True)] + [(-180.0, 0.0), (180.0, 10.0), (3.0, -0.0001)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    east, north = X.utm(F.col("lon"), F.col("lat"))
    there = df.select("*", X.zone_of(F.col("lon")).alias("z"), east.alias("e"), north.alias("n"))
    lon, lat = X.from_utm(F.col("e"), F.col("n"), F.col("z"), F.col("lat") < 0)
    back = there.select("*", lon.alias("lon2"), lat.alias("lat2"))
    again = [c.alias(k) for c, k in zip(X.utm(F.col("lon2"), F.col("lat2"), F.col("z"), F.col("lat") < 0), ("e2", "n2"), strict=True)]
    for r in back.select("*", *again).collect():
        assert abs((r["lon2"] - r["lon"] + 180) % 360 - 180) < 1e-8 and abs(r["lat2"] - r["lat"]) < 1e-8 and 1 <= r["z"] <= 60
        assert abs(r["e2"] - r["e"]) < 1e-3 and abs(r["n2"] - r["n"]) < 1e-3 and r["n"] > -1e-6


def test_utm_known_places(spark):
    """Published pairs: the equator on a middle meridian, and a meridian arc (the quarter's length to 45 degrees)."""
    east, north = X.utm(F.lit(3.0), F.lit(0.0), 31)
    up = X.utm(F.lit(3.0), F.lit(45.0), 31)[1]
    down = X.utm(F.lit(3.0), F.lit(-45.0), 31)[1]
    r = spark.range(1).select(east, north, up, down).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1]) < 1e-6 and abs(r[2] - 0.9996 * 4984944.378) < 0.002 and abs(r[3] - (1e7 - r[2])) < 1e-6


def test_small_expressions(spark):
    df = spark.createDataFrame([("1717200000000",), ("2024-06-01 00:00:00",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(X.taken_at(F.col("t")).cast("string")).collect()] == ["2024-06-01 00:00:00", "2024-06-01 00:00:00", "None", "None"]
    assert str(spark.range(1).select(X.taken_at(F.lit(1717200000000)).cast("string")).first()[0]) == "2024-06-01 00:00:00"
    box = tuple(map(F.lit, (-10.0, 40.0, -6.0, 50.0)))
    assert tuple(spark.range(1).select(*X.locator_percent(F.lit(-9.0), F.lit(47.5), box)).first()) == (25.0, 25.0)
    assert tuple(spark.range(1).select(*X.locator_percent(F.lit(1.0), F.lit(1.0), tuple(map(F.lit, (1.0, 1.0, 1.0, 2.0))))).first()) == (None, 100.0)
    assert spark.range(1).select(X.geoid(F.lit(6), F.lit("37"), F.lit("1100"), F.lit(2))).first()[0] == "060370011002"
    assert spark.range(1).select(X.geoid(F.lit(6), F.lit("37"), F.lit("1100"))).first()[0] == "06037001100"


def test_json_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id": "a", "road": 0.25, "sky": 1, "extra": 3}\n{"id": "b"}\n')
    got = sorted(map(tuple, files.jsonl(spark, str(tmp_path / "f.jsonl"), "image_features").select("id", "road", "sky").collect()))
    assert got == [("a", 0.25, 1.0), ("b", None, None)]


def test_calls_are_tried_again(monkeypatch):
    """Two failures, then an answer; and one failure more than there are tries."""
    import io
    import urllib.error
    import urllib.request

    calls, waits = [], []

    def answer(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("busy")
        return io.BytesIO(b'{"count": 7}')

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    assert paged.count({"url": "http://service.invalid/query", "wait": "2"}) == 7 and waits == [2.0, 4.0] and "returnCountOnly=true" in calls[0]
    calls.clear()
    with pytest.raises(urllib.error.URLError):
        paged.count({"url": "http://service.invalid/query", "tries": "2", "wait": "0"})
