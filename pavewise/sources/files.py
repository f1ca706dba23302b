"""Readers with declared schemas, and sinks."""

from __future__ import annotations

import csv as csv_lines
import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas of file inputs.
SCHEMAS = {
    "stop_times": "stop_id string, departure_time string",
    "stops": "stop_id string, stop_lat double, stop_lon double",
    "images": "id string, lon double, lat double, captured_at long, compass_angle double, is_pano boolean",
    "image_features": "id string, road double, sidewalk double, building double, pole double, vegetation double, sky double",
    "votes": "ts_iso string, rater string, pair_id int, pair_type string, seg_left long, seg_right long, img_left string, img_right string, side_of_a string, choice string, winner_seg string, loser_seg string",
    "jobs": "w_geocode string, C000 long",
}


def csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV (compressed or not) with a header, by name: columns of the schema that the file lacks are an error."""
    wanted = [f.split(" ")[0] for f in SCHEMAS[kind].split(", ")]
    rows = spark.read.csv(path, header=True)
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}")
    kinds = dict(f.split(" ") for f in SCHEMAS[kind].split(", "))
    return rows.select(*[F.expr(f"try_cast(`{c}` as {kinds[c]})").alias(c) for c in wanted])


def jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).json(path)


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays whose first one names the columns; all values are strings. The header row is read alone.

    The file is read line by line, so rows that stand on lines of their own (as census services send them) are parsed where they
    lie; several rows on one line, even all of them, are read as well. Files of one path have the same header.
    """
    line = F.regexp_replace(F.trim("value"), r",$", "")
    whole = F.concat(F.when(line.startswith("[["), "").otherwise("["), line, F.when(line.endswith("]]"), "").otherwise("]"))
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(line.startswith("[[").alias("first"), F.from_json(whole, "array<array<string>>").alias("t"))
    found = rows.filter("first").select(F.col("t")[0]).first()
    if found is None:
        raise ValueError(f"{path} has no header")
    body = rows.select(F.explode(F.when(F.col("first"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).otherwise(F.col("t"))).alias("r"))
    return body.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(found[0])])


def zip_member(spark: SparkSession, path: str, member: str, wanted: list[str]) -> DataFrame:
    """The wanted columns (strings, null where a row or the header lacks them) of a CSV inside zip archives.

    One archive is one task; its rows are passed on in batches as they are read. Archives without the member give none.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        continue
                    rows = csv_lines.DictReader(io.TextIOWrapper(z.open(member), "utf-8-sig", newline=""))
                    while part := list(islice(rows, 10_000)):
                        yield pd.DataFrame({c: [r.get(c) for r in part] for c in wanted}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{c}` string" for c in wanted))


def geojson_lines(df: DataFrame, path: str, geometry_wkt: str, xs: Column, ys: Column) -> None:
    """One GeoJSON LineString feature a line; all other columns are properties."""
    props = F.struct(*[c for c in df.columns if c != geometry_wkt])
    pairs = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("value")).write.text(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_of(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there, such as the newest of several years' files."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths}")


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path, built and written first if it isn't there or is to be rebuilt."""
    if rebuild or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_log(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys the Parquet log lacks; the number written. A log that isn't there yet begins with these.

    A log without the keys, or with other types, is an error.
    """
    fresh = rows.dropDuplicates(keys)
    if exists(rows.sparkSession, path):
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the largest order (of equal ones, the largest row)."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_b"))
    return best.select(*[F.col(key) if c == key else F.col(f"_b.{c}") for c in rows.columns])


def released(rows: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Those of the columns that rows has, in this order, doubles rounded half to even."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.bround(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns if c in kinds])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_report(one: DataFrame, path: str) -> None:
    """A report of one row as JSON; a report of more is an error."""
    if len(got := one.limit(2).collect()) != 1:
        raise ValueError("a report has one row")
    one.sparkSession.createDataFrame(got, one.schema).coalesce(1).write.json(path)


RINGS = "array<struct<part:int,xs:array<double>,ys:array<double>>>"


def _shapes(raw: bytes) -> list[tuple[int, np.ndarray]]:
    """(part, vertices) of every ring of one shape: dimensions after the second, and a reference system's number, are passed over."""
    found: list[tuple[int, np.ndarray]] = []

    def one(at: int, part: int) -> int:
        order = "<" if raw[at] else ">"
        word = int(np.frombuffer(raw, f"{order}u4", 1, at + 1)[0])
        kind = word & 0x0FFFFFFF
        wide = 2 + bool(word & 0x80000000 or kind // 1000 in (1, 3)) + bool(word & 0x40000000 or kind // 1000 in (2, 3))
        kind, at = kind % 1000, at + 5 + 4 * bool(word & 0x20000000)

        def vertices(n: int, at: int) -> int:
            found.append((part, np.frombuffer(raw, f"{order}f8", wide * n, at).astype(float).reshape(n, wide)[:, :2]))
            return at + 8 * wide * n

        def number(at: int) -> int:
            return int(np.frombuffer(raw, f"{order}u4", 1, at)[0])

        if kind == 1:
            return vertices(1, at)
        if kind == 2:
            return vertices(number(at), at + 4)
        if kind == 3:
            n, at = number(at), at + 4
            for _ in range(n):
                at = vertices(number(at), at + 4)
            return at
        if kind in (4, 5, 6):
            n, at = number(at), at + 4
            for k in range(n):
                at = one(at, k)
            return at
        raise ValueError(f"shape {kind} is not read")

    one(0, 0)
    return found


def _decoded(column: pa.Array) -> pa.Array:
    """RINGS of a column of well-known binary; polygons of one ring, in the usual byte order and two dimensions, all at once."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size, known = np.diff(offsets), ~column.is_null().to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(known & (size >= 13))
    heads = data[offsets[plain][:, None] + np.arange(13)] if len(plain) else np.zeros((0, 13), np.uint8)
    usual = (heads[:, :9] == np.array([1, 3, 0, 0, 0, 1, 0, 0, 0], np.uint8)).all(1)
    plain, count = plain[usual], np.ascontiguousarray(heads[usual, 9:13]).view("<u4")[:, 0].astype(np.int64)
    fits = size[plain] == 13 + 16 * count
    plain, count = plain[fits], count[fits]
    first = np.repeat(offsets[plain] + 13 - np.r_[0, np.cumsum(16 * count)[:-1]] if len(plain) else np.zeros(0, np.int64), 16 * count)
    xy = np.ascontiguousarray(data[first + np.arange(len(first))]).view("<f8").reshape(-1, 2)
    starts = np.r_[0, np.cumsum(count)]
    rings: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for i, a, b in zip(plain.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        rings[i] = [(0, xy[a:b])]
    for i in np.setdiff1d(np.flatnonzero(known), plain).tolist():
        rings[i] = _shapes(data[offsets[i] : offsets[i + 1]].tobytes())
    flat = [r for own in rings for r in own]
    points = np.concatenate([p for _, p in flat]) if flat else np.zeros((0, 2))
    at = pa.array(np.r_[0, np.cumsum([len(p) for _, p in flat])] if flat else [0], pa.int32())
    axes = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(points[:, k]))) for k in range(2)]
    each = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int32()), *axes], ["part", "xs", "ys"])
    ends = np.r_[0, np.cumsum([len(own) for own in rings])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[~known, False]), each)


def wkb_vertices(wkb: Column) -> Column:
    """rings (structs part, xs, ys) of well-known binary: a point or line has one, a polygon its shell and holes, and a shape of
    several parts those of each, by part. Further dimensions are left out, null stays null, either byte order is read; other
    shapes are an error.
    """

    @F.arrow_udf(RINGS)
    def rings(values: pa.Array) -> pa.Array:
        return _decoded(values.cast(pa.binary()))

    return rings(wkb)


def with_box(shapes: DataFrame, rings: str = "rings") -> DataFrame:
    """shapes with bbox (xmin, ymin, xmax, ymax) of their rings."""
    end = lambda f, axis: f(F.transform(rings, lambda r: f(r[axis])))
    ends = [end(f, f"{a}s").alias(f"{a}{n}") for n, f in (("min", F.array_min), ("max", F.array_max)) for a in "xy"]
    return shapes.withColumn("bbox", F.struct(*ends))


def write_shapes(shapes: DataFrame, path: str, cell: float, **options: str) -> None:
    """Write shapes that have a bbox so that those of one neighbourhood share row groups: in ranges of a curve through cells of this size."""
    x, y = (F.floor(F.col(f"bbox.{a}min") / cell).cast("long") for a in "xy")
    curve = reduce(lambda p, k: p.bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)), range(20), F.lit(0).cast("long"))
    ranged = shapes.withColumn("_curve", curve).repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve")
    ranged.write.options(**options).parquet(path)


def shapes_in(spark: SparkSession, path: str, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Shapes whose bbox meets a box. The comparisons reach the file's row groups, whose statistics rule out those elsewhere."""
    box = F.col("bbox")
    return spark.read.parquet(path).filter((box["xmin"] <= max_x) & (box["xmax"] >= min_x) & (box["ymin"] <= max_y) & (box["ymax"] >= min_y))


def image_grid(min_lon: float, min_lat: float, max_lon: float, max_lat: float, k: int, spark: SparkSession) -> DataFrame:
    """(cell, min_lon, ..): k x k boxes of an area, for services that limit what one call returns."""
    i, j = (F.col("id") % k), F.floor(F.col("id") / k)
    w, h = (max_lon - min_lon) / k, (max_lat - min_lat) / k
    return spark.range(k * k).select(F.col("id").alias("cell"), (min_lon + i * w).alias("min_lon"), (min_lat + j * h).alias("min_lat"), (min_lon + (i + 1) * w).alias("max_lon"), (min_lat + (j + 1) * h).alias("max_lat"))
