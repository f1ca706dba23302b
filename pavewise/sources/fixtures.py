"""Derived metric-plane views of the driver tables: the same SQL text runs on Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "segments": """
        SELECT p_partkey AS seg_id, (p_partkey % 997) AS u, ((p_partkey * 31 + 7) % 997) AS v, (p_partkey % 2) AS key, CASE p_partkey % 11 WHEN 0 THEN
        'footway' WHEN 1 THEN 'residential' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'primary' WHEN 5 THEN 'path' WHEN 6 THEN 'pedestrian'
        WHEN 7 THEN 'living_street' WHEN 8 THEN 'unclassified' WHEN 9 THEN 'steps' ELSE 'motorway' END AS highway, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1
        THEN '25 mph' WHEN 2 THEN '30;35 mph' WHEN 3 THEN 'signals' ELSE '40' END AS maxspeed, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2' WHEN 2 THEN
        '4' ELSE '3;2' END AS lanes_tag, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'both' WHEN 2 THEN 'no' WHEN 3 THEN 'Separate' WHEN 4 THEN 'none'
        ELSE 'left' END AS sidewalk, CAST((p_partkey * 7919) % 20011 AS DOUBLE) / 10 AS x1, CAST((p_partkey * 104729) % 20011 AS DOUBLE) / 10 AS y1, CAST(10
        AS DOUBLE) + CAST(p_size AS DOUBLE) * CAST(2.5 AS DOUBLE) AS length_m, CAST(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.6 ELSE
        0.8 END AS DOUBLE) AS ux, CAST(CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE -0.6 END AS DOUBLE) AS uy FROM part
    """,
    "lamps": """
        SELECT c_custkey AS lamp_id, CAST((c_custkey * 6007) % 20011 AS DOUBLE) / 10 AS x, CAST((c_custkey * 15013) % 20011 AS DOUBLE) / 10 AS y, CASE WHEN
        c_custkey % 50 = 0 THEN NULL ELSE CAST(40 + c_nationkey * 10 AS DOUBLE) END AS wattage, CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE CAST(6 + c_custkey
        % 30 AS DOUBLE) END AS height_ft, c_mktsegment AS fixture_type, (c_custkey % 13 = 0) AS retired FROM customer
    """,
    "buildings": """
        SELECT o_orderkey AS bld_id, CAST((o_orderkey * 5003) % 20011 AS DOUBLE) / 10 AS minx, CAST((o_orderkey * 9001) % 20011 AS DOUBLE) / 10 AS miny,
        CAST((o_orderkey * 5003) % 20011 AS DOUBLE) / 10 + CAST(8 + o_orderkey % 17 AS DOUBLE) AS maxx, CAST((o_orderkey * 9001) % 20011 AS DOUBLE) / 10 +
        CAST(8 + o_orderkey % 13 AS DOUBLE) AS maxy, CASE WHEN o_orderkey % 10 IN (0, 5) AND o_orderkey % 3 = 0 THEN NULL ELSE CAST(3 + o_custkey % 40 AS
        DOUBLE) END AS height FROM orders WHERE o_orderkey % 5 = 0
    """,
    "places": """
        SELECT o_orderkey AS place_id, CAST((o_orderkey * 3001) % 20011 AS DOUBLE) / 10 AS x, CAST((o_orderkey * 7001) % 20011 AS DOUBLE) / 10 AS y, CASE
        substr(o_orderpriority, 1, 1) WHEN '1' THEN '{"primary":"Cocktail_Bar"}' WHEN '2' THEN '{"primary":"clothing_store"}' WHEN '3' THEN
        '{"primary":"coffee_shop"}' WHEN '4' THEN 'not json' ELSE NULL END AS categories FROM orders WHERE o_orderkey % 5 = 1
    """,
    "incidents": """
        SELECT event_id, CAST((event_id * 4001) % 20011 AS DOUBLE) / 10 AS x, CAST((event_id * 8009) % 20011 AS DOUBLE) / 10 AS y, ts, extract(hour FROM ts)
        AS hr, value FROM events WHERE event_type = 'error'
    """,
    "tracts": """
        SELECT n_nationkey AS tract_id, CAST(n_nationkey % 5 AS DOUBLE) * 400 AS minx, CAST(CAST(floor(n_nationkey / 5.0) AS BIGINT) AS DOUBLE) * 400 AS miny,
        CAST((n_nationkey * 37) % 80 AS DOUBLE) AS low_income_share FROM nation
    """,
    "stop_times": """
        SELECT (event_id % 60) AS stop_id, concat(CAST(4 + (event_id * 7 + user_id) % (6 + (event_id % 60) % 17) AS STRING), ':15:00') AS departure_time FROM
        events WHERE event_type = 'view'
    """,
    "images": """
        SELECT event_id AS image_id, CAST((event_id * 2003) % 20011 AS DOUBLE) / 10 AS x, CAST((event_id * 6101) % 20011 AS DOUBLE) / 10 AS y, ts AS
        captured_at, CAST(user_id * 7 % 360 AS DOUBLE) AS compass_angle, (event_id % 9 = 0) AS is_pano, CAST((event_id * 37) % 100 AS DOUBLE) / 400 AS road,
        CAST((event_id * 53) % 100 AS DOUBLE) / 400 AS sidewalk FROM events WHERE event_type = 'click'
    """,
    "votes": """
        SELECT event_id, ts AS ts_iso, CASE user_id % 5 WHEN 0 THEN 'human1' WHEN 1 THEN 'human2' ELSE concat('ai:panel-r', CAST(user_id % 5 - 1 AS STRING))
        END AS rater, event_id % 200 AS pair_id, (event_id % 200) % 6 AS city_id, CASE WHEN value < 20 THEN 'L' WHEN value < 60 THEN 'R' WHEN value < 80 THEN
        'tie' ELSE 'skip' END AS choice, (event_id % 200) * 2 % 200 AS seg_left, ((event_id % 200) * 6 + 1) % 200 AS seg_right FROM events WHERE event_type IN
        ('purchase', 'signup')
    """,
    "stops": """
        SELECT event_id AS stop_id, CAST((event_id * 4507) % 20011 AS DOUBLE) / 10 AS x, CAST((event_id * 8803) % 20011 AS DOUBLE) / 10 AS y FROM (SELECT
        DISTINCT event_id % 60 AS event_id FROM events)
    """,
    "crossings": """
        SELECT c_custkey AS crossing_id, CAST((c_custkey * 5501) % 20011 AS DOUBLE) / 10 AS x, CAST((c_custkey * 9901) % 20011 AS DOUBLE) / 10 AS y FROM
        customer WHERE c_custkey % 3 = 0
    """,
    "graph_edges": """
        SELECT event_id AS edge_id, CAST(floor(event_id / 2.0) AS BIGINT) AS u, CAST(floor(event_id / 2.0) AS BIGINT) + CASE WHEN event_id % 2 = 0 THEN 1 ELSE
        side END AS v, CAST(40 + (event_id * 37) % 60 AS DOUBLE) AS length_m, CAST((event_id * 53) % 100 AS DOUBLE) / 100 AS comfort, side FROM events, (SELECT
        CAST(floor(sqrt(count(*) / 2.0)) AS BIGINT) AS side FROM events)
    """,
    "lines": """
        SELECT p_partkey AS seg_id, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END AS n, CAST((p_partkey * 7919) % 20011 AS DOUBLE) / 10 AS x0, CAST((p_partkey
        * 104729) % 20011 AS DOUBLE) / 10 AS y0, CAST((p_partkey * 7919) % 20011 AS DOUBLE) / 10 + p_size AS x1, CAST((p_partkey * 104729) % 20011 AS DOUBLE)
        / 10 + p_partkey % 7 AS y1, CAST((p_partkey * 7919) % 20011 AS DOUBLE) / 10 + p_size + p_partkey % 5 AS x2, CAST((p_partkey * 104729) % 20011 AS
        DOUBLE) / 10 + 3 * (p_partkey % 11) AS y2, CAST((p_partkey * 7919) % 20011 AS DOUBLE) / 10 + 2 * p_size AS x3, CAST((p_partkey * 104729) % 20011 AS
        DOUBLE) / 10 + 20 AS y3 FROM part
    """,
    "plots": """
        SELECT n_nationkey AS plot_id, CAST(n_nationkey % 5 AS DOUBLE) * 400 AS x, CAST(CAST(floor(n_nationkey / 5.0) AS BIGINT) AS DOUBLE) * 400 AS y,
        CAST(40 + n_nationkey * 3 AS DOUBLE) AS hole FROM nation
    """,
    "houses": """
        SELECT o_orderkey AS bld_id, CAST((o_orderkey * 5003) % 20011 AS DOUBLE) / 10 AS x, CAST((o_orderkey * 9001) % 20011 AS DOUBLE) / 10 AS y, CAST(4 +
        o_orderkey % 9 AS DOUBLE) AS a, CAST(3 + o_orderkey % 7 AS DOUBLE) AS b, CASE WHEN o_orderkey % 10 IN (0, 5) AND o_orderkey % 3 = 0 THEN NULL ELSE
        CAST(3 + o_custkey % 40 AS DOUBLE) END AS height FROM orders WHERE o_orderkey % 5 = 0
    """,
    "job_blocks": """
        SELECT concat(lpad(CAST(n_regionkey AS STRING), 2, '0'), '037', lpad(CAST(n_nationkey AS STRING), 6, '0'), '1', lpad(CAST(c_custkey % 1000 AS STRING),
        3, '0')) AS w_geocode, c_custkey % 50 AS c000 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 6 <> 5
    """,
    "acs_rows": """
        SELECT concat(lpad(CAST(n_regionkey AS STRING), 2, '0'), '037', lpad(CAST(n_nationkey AS STRING), 6, '0'), '1') AS geoid, CASE WHEN n_nationkey % 8 =
        0 THEN '-666666666' ELSE CAST(20000 + n_nationkey * 3001 AS STRING) END AS b19013_001e, CAST((n_nationkey * 97) % 500 AS STRING) AS b02001_001e,
        CAST((n_nationkey * 41) % 90 AS STRING) AS b02001_002e FROM nation
    """,
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the files themselves: no temporary view is made, so nothing of the session's is replaced."""
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir.rstrip('/')}/{m[2]}.parquet`", VIEWS[name]))


def ctes(*names: str) -> str:
    """WITH clause that gives an oracle the same views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
