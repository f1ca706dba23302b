"""A Spark data source for paged feature services, one partition for each page, with predicates sent along.

Options: ``url`` (a service's query address, http(s) or a folder of page files for tests), ``page`` (rows in a page), ``where``
(the service's own predicate), ``bbox`` (min_lon,min_lat,max_lon,max_lat), ``order`` (field that pages are cut by), ``total``
(rows, else asked of the service), ``columns`` (names, comma-joined; else all), ``tries`` and ``wait`` (seconds) for transient
failures, ``dialect`` (``features`` or ``rows``: a service of plain JSON rows with $select, $where, $order, $limit and $offset, whose
box is a comparison of the columns lon and lat). Rows are (lon, lat, attributes JSON string).

A service may return fewer rows than a page asks for: a partition goes on until it has all rows that are due, and fails
rather than lose some. Comparisons of lon and lat with numbers narrow the box that is sent; Spark applies them again.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pavewise.session import checkpointed, importable


class Page(InputPartition):
    def __init__(self, offset: int, due: int):
        self.offset, self.due = offset, due


def _folder(options: dict, params: dict):
    """A folder as a service: the page file ``<offset>.json`` (``count.json`` for the count), or ``all.json``, all its features,
    from which box, offset and number of rows are answered."""
    url = options["url"]
    if "all.json" in os.listdir(url) and not {"outStatistics", "schema"} & set(params):
        with open(os.path.join(url, "all.json"), encoding="utf-8") as f:
            rows = json.load(f)["features"]
        if box := params.get("geometry") or options.get("bbox"):
            x0, y0, x1, y1 = map(float, box.split(","))
            rows = [r for r in rows if x0 <= r["geometry"]["x"] <= x1 and y0 <= r["geometry"]["y"] <= y1]
        at = params.get("resultOffset", 0)
        return {"count": len(rows)} if params.get("returnCountOnly") else {"features": rows[at : at + params["resultRecordCount"]]}
    kind = next((k for k in ("returnCountOnly", "outStatistics", "schema") if k in params), None)
    name = {"returnCountOnly": "count.json", "outStatistics": "groups.json", "schema": "fields.json"}.get(kind) or f"{params['resultOffset']}.json"
    with open(os.path.join(url, name), encoding="utf-8") as f:
        return json.load(f)


def query_of(options: dict, params: dict) -> dict:
    """The parameters that one call sends."""
    box, columns = params.get("geometry") or options.get("bbox"), options.get("columns")
    if options.get("dialect") == "rows":
        where = options.get("where", "1=1")
        if box:
            x0, y0, x1, y1 = box.split(",")
            where = f"({where}) AND lon >= {x0} AND lon <= {x1} AND lat >= {y0} AND lat <= {y1}"
        if params.get("returnCountOnly"):
            return {"$where": where, "$select": "count(*) as count"}
        own = {"$where": where, "$order": options.get("order", ":id"), "$limit": params["resultRecordCount"], "$offset": params.get("resultOffset", 0)}
        return own | ({"$select": ",".join(dict.fromkeys([*columns.split(","), "lon", "lat"]))} if columns else {})
    query = {"where": options.get("where", "1=1"), "outFields": columns or "*", "outSR": "4326", "f": "json", **params}
    if "resultOffset" in params:
        query["orderByFields"] = options.get("order", "OBJECTID")
    if box:
        query |= {"geometry": box, "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects"}
    return query


def request(options: dict, **params) -> dict:
    """One call: a service's JSON."""
    url = options["url"]
    if os.path.isdir(url):
        return _folder(options, params)
    query = query_of(options, params)
    tries, wait = int(options.get("tries", "4")), float(options.get("wait", "2"))
    for k in range(tries):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=45) as r:
                return json.load(r)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * (k + 1))
    raise ValueError("tries must be positive")


def count(options: dict) -> int:
    got = request(options, returnCountOnly="true")
    return int(got[0]["count"] if isinstance(got, list) else got["count"])


def group_count(options: dict, field: str) -> dict:
    """Rows by value of a field, counted by the service."""
    stat = json.dumps([{"statisticType": "count", "onStatisticField": field, "outStatisticFieldName": "n"}])
    got = request(options, outStatistics=stat, groupByFieldsForStatistics=field)
    return {f["attributes"][field]: f["attributes"]["n"] for f in got.get("features", [])}


def fields(options: dict) -> list[tuple[str, str]]:
    """(name, type) of a layer's fields."""
    return [(f["name"], f["type"]) for f in request(options, schema="true").get("fields", [])]


def narrowed(box: str | None, filters: list) -> str | None:
    """The box that comparisons of lon and lat with numbers leave of another (of the whole world, if there is none)."""
    lo, hi = [-180.0, -90.0], [180.0, 90.0]
    if box:
        v = [float(x) for x in box.split(",")]
        lo, hi = v[:2], v[2:]
    found = bool(box)
    for f in filters:
        at = {("lon",): 0, ("lat",): 1}.get(getattr(f, "attribute", None))
        if at is not None and isinstance(getattr(f, "value", None), int | float):
            kind = type(f).__name__
            if kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                lo[at], found = max(lo[at], float(f.value)), True
            if kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
                hi[at], found = min(hi[at], float(f.value)), True
    return ",".join(map(repr, [*lo, *hi])) if found else None


def _features(got) -> list[tuple]:
    """(lon, lat, attributes) of a call's rows."""
    if isinstance(got, list):
        return [(row.get("lon"), row.get("lat"), row) for row in got]
    return [((f.get("geometry") or {}).get("x"), (f.get("geometry") or {}).get("y"), f.get("attributes") or {}) for f in got.get("features", [])]


def enumerated(spark: SparkSession, options: dict, box: tuple[float, float, float, float], limit: int, key: str, grid: int = 4, deepest: int = 16, lossy: bool = False) -> DataFrame:
    """(id, lon, lat, attributes, capped): all features in a box of a service that returns ``limit`` rows a call at most.

    The box begins as grid x grid cells, asked for side by side. A cell whose answer is as long as the limit may lack rows: it is
    split into four, and so on until no answer is; a round's cells are one table. Features on a shared edge come once, by
    the attribute ``key``. Where more features than the limit lie within a cell of the deepest level, that is an error, or, if
    ``lossy``, the rows of such cells are marked as capped.
    """
    importable(spark)
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) / grid, (y1 - y0) / grid
    i, j = F.col("id") % grid, F.floor(F.col("id") / grid)
    cells = spark.range(0, grid * grid, 1, min(grid * grid, 64)).select((x0 + i * w).alias("x0"), (y0 + j * h).alias("y0"), (x0 + (i + 1) * w).alias("x1"), (y0 + (j + 1) * h).alias("y1"))

    def ask(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                rows = _features(request(options, geometry=",".join(map(repr, map(float, cell))), resultRecordCount=limit))
                full = len(rows) >= limit
                if full and not last:
                    yield pd.DataFrame([(*cell, True, None, None, None, None, False)], columns=names)
                elif rows:
                    yield pd.DataFrame([(*cell, False, str(a[key]), lon, lat, json.dumps(a), full) for lon, lat, a in rows], columns=names)

    names = ["x0", "y0", "x1", "y1", "split", "id", "lon", "lat", "attributes", "capped"]
    schema = "x0 double, y0 double, x1 double, y1 double, split boolean, id string, lon double, lat double, attributes string, capped boolean"
    found = []
    for level in range(deepest + 1):
        answers = checkpointed(cells.mapInPandas(lambda b, last=level == deepest: ask(b, last), schema))
        found.append(answers.filter("not split").select("id", "lon", "lat", "attributes", "capped"))
        halves = answers.filter("split").select("x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
        if halves.isEmpty():
            break
        quarters = F.array(*[F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1")) for a, c in (("x0", "mx"), ("mx", "x1")) for b, d in (("y0", "my"), ("my", "y1"))])
        cells = halves.select(F.explode(quarters).alias("c")).select("c.*").repartition(min(64, 4 * max(1, halves.count())))
    rows = reduce(DataFrame.unionByName, found)
    if not lossy and not rows.filter("capped").isEmpty():
        raise RuntimeError(f"over {limit} features in a cell of the deepest level")
    whole = F.max_by(F.struct("lon", "lat", "attributes"), F.col("attributes")).alias("f")
    return rows.groupBy("id").agg(whole, F.max("capped").alias("capped")).select("id", "f.lon", "f.lat", "f.attributes", "capped")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.page = int(options.get("page", "2000"))
        self.pushed = False

    def pushFilters(self, filters: list) -> list:
        if box := narrowed(self.options.get("bbox"), filters):
            self.pushed = box != self.options.get("bbox")
            self.options["bbox"] = box
        return filters

    def partitions(self) -> list[Page]:
        known = self.options.get("total") if not self.pushed else None  # a narrower box has fewer rows than the total that was given
        n = int(known) if known else count(self.options)
        return [Page(k, min(self.page, n - k)) for k in range(0, n, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        done = 0
        while done < partition.due:
            got = request(self.options, resultOffset=partition.offset + done, resultRecordCount=partition.due - done)
            rows = _features(got)
            if not rows:
                raise RuntimeError(f"the service gave {done} of {partition.due} rows at {partition.offset}")
            for lon, lat, rest in rows[: partition.due - done]:
                yield *(None if v is None else float(v) for v in (lon, lat)), json.dumps(rest)
            done += len(rows)


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "lon double, lat double, attributes string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Register the source in a session, with filter pushdown, which its reader has."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeatures)
