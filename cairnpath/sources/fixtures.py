"""The model's tables as projections of the driver's tables.

Each is one SELECT in the part of SQL that Spark and DuckDB read alike, so that both engines start from the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnpath.operators.graph import dealt


def h(k: str) -> str:
    """The multiplicative hash of a key expression, a bigint under 2147483647."""
    return f"(CAST({k} AS BIGINT) * 2654435761 % 2147483647)"


def u(k: str) -> str:
    """The hash as a double from 0 to 1."""
    return f"(CAST({h(k)} AS DOUBLE) / CAST(2147483647 AS DOUBLE))"


#: Eight directions, counterclockwise: rings have a vertex in each, so they may be concave but don't cross themselves.
COMPASS = "(VALUES (0, 1e0, 0e0), (1, 0.7e0, 0.7e0), (2, 0e0, 1e0), (3, -0.7e0, 0.7e0), (4, -1e0, 0e0), (5, -0.7e0, -0.7e0), (6, 0e0, -1e0), (7, 0.7e0, -0.7e0)) AS k(i, dx, dy)"


def star(key: str, low: int, more: int, shrink: str = "1e0") -> str:
    """x and y of a ring's vertex around a place by key, at a distance of its own."""
    away = f"({low}e0 + {more}e0 * {u(f'{key} * 8 + k.i')}) * {shrink}"
    return f"ROUND({u(f'{key} * 3 + 1')} * 100000e0 + {away} * k.dx, 1) AS x, ROUND({u(f'{key} * 11 + 5')} * 100000e0 + {away} * k.dy, 1) AS y"


TABLES = {
    "lake_rings": f"SELECT p_partkey AS shape, 0 AS ring, k.i AS pos, {star('p_partkey', 100, 300)} FROM part CROSS JOIN {COMPASS}",
    "parcel_rings": f"""SELECT s_suppkey AS shape, 0 AS ring, k.i AS pos, {star('s_suppkey', 2000, 6000)} FROM supplier CROSS JOIN {COMPASS}
        UNION ALL SELECT s_suppkey AS shape, 1 AS ring, 7 - k.i AS pos, {star('s_suppkey', 2000, 6000, '0.3e0')} FROM supplier CROSS JOIN {COMPASS}""",
    "parcels": """SELECT s_suppkey AS shape, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unknown' ELSE 'closed' END AS access,
        CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4' END AS gap FROM supplier""",
    "broken_rings": f"""SELECT p_partkey AS shape, 0 AS ring, CASE p_partkey % 4 WHEN 0 THEN (k.i * 3) % 8 WHEN 1 THEN k.i WHEN 2 THEN 7 - k.i ELSE (k.i * 5) % 8 END AS pos, {star('p_partkey', 100, 300)} FROM part CROSS JOIN {COMPASS}
        UNION ALL SELECT p_partkey AS shape, 0 AS ring, 8 + k.i AS pos, {star('p_partkey', 100, 300)} FROM part CROSS JOIN {COMPASS} WHERE p_partkey % 3 = 0 AND k.i < 2""",
    "sites": f"""SELECT c_custkey AS site_id, {u('c_custkey')} * 100000e0 AS x_m, {u('c_custkey * 7 + 3')} * 100000e0 AS y_m,
        CASE c_custkey % 4 WHEN 0 THEN 'campground' WHEN 1 THEN 'lean_to' WHEN 2 THEN 'backcountry' ELSE 'unknown' END AS site_type,
        CASE c_custkey % 3 WHEN 0 THEN 'ridb' ELSE 'osm' END AS source, c_name AS name,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 5e0 END AS elevation_m FROM customer""",
    "water": f"""SELECT p_partkey AS water_id, {u('p_partkey * 3 + 1')} * 100000e0 AS x_m, {u('p_partkey * 11 + 5')} * 100000e0 AS y_m,
        CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS perennial,
        CASE p_partkey % 5 WHEN 0 THEN 'stream' WHEN 1 THEN 'lake' WHEN 2 THEN 'spring' WHEN 3 THEN 'wetland' ELSE 'other' END AS feature_type,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS name FROM part""",
    "land": """SELECT n_nationkey AS land_id, n_name AS name, CAST(n_nationkey % 5 AS DOUBLE) * 20000e0 - 2000e0 AS min_x, CAST(n_nationkey % 5 AS DOUBLE) * 20000e0 + 15000e0 AS max_x,
        CAST(FLOOR(n_nationkey / 5e0) AS DOUBLE) * 20000e0 - 2000e0 AS min_y, CAST(FLOOR(n_nationkey / 5e0) AS DOUBLE) * 20000e0 + 21000e0 AS max_y,
        CASE n_nationkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unknown' ELSE 'closed' END AS access,
        CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4' END AS gap FROM nation""",
    "vertices": f"""SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS node_id,
        {u('l_orderkey')} * 100000e0 + CAST({h('l_partkey')} % 4000 AS DOUBLE) AS x_m, {u('l_orderkey * 5 + 2')} * 100000e0 + CAST({h('l_partkey * 3 + 1')} % 4000 AS DOUBLE) AS y_m FROM lineitem""",
    "profile": """SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) * 25e0 AS along_m,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS z_m FROM events""",
    "fixes": f"""SELECT user_id AS track_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS BIGINT) AS t_s,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) * 6e0 + CAST({h('event_id')} % 100 AS DOUBLE) / 10e0 AS x_m,
        CAST({h('event_id * 3 + 1')} % 100 AS DOUBLE) / 10e0 AS y_m, CAST({h('event_id * 7 + 2')} % 50 AS DOUBLE) AS accuracy_m FROM events""",
    "edges": """SELECT u * 100000000 + v AS edge_id, u, v, min(length_m) AS length_m, min(ascent_m) AS ascent_m, min(descent_m) AS descent_m FROM (
        SELECT l_partkey AS u, l_suppkey + 10000000 AS v, CAST(FLOOR(l_extendedprice) % 5000 + 100 AS DOUBLE) AS length_m,
        l_quantity AS ascent_m, CAST(l_linenumber AS DOUBLE) AS descent_m FROM lineitem WHERE l_quantity <= 8) GROUP BY u, v""",
    "routes": """SELECT o_orderkey AS route_id, o_totalprice / 10e0 AS length_m, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 300e0 END AS gain_m,
        o_totalprice / 350e0 AS loss_m, o_orderpriority AS name, o_custkey AS member_site, o_orderstatus AS kind FROM orders""",
    "grid": """SELECT ix, iy, CASE WHEN (ix * 31 + iy * 17) % 101 = 0 THEN NULL ELSE CAST((ix * 73 + iy * 179) % 97 AS DOUBLE) END AS z FROM (
        SELECT p_partkey % 50 AS ix, CAST(FLOOR(p_partkey / 50e0) AS BIGINT) AS iy FROM part GROUP BY 1, 2)""",
    "weather": """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 13 AS DOUBLE) END AS rain_mm, CAST(c_custkey % 60 AS DOUBLE) AS wind_kmh,
        CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 25 AS DOUBLE) - 12e0 END AS low_c FROM customer""",
    "terrain": """SELECT c_custkey AS site_id, CAST(c_custkey % 300 AS DOUBLE) / 10e0 AS slope_deg, CAST(c_custkey % 140 AS DOUBLE) / 10e0 AS twi, CAST(c_custkey % 17 AS DOUBLE) / 40e0 AS sink_m,
        CAST(c_custkey % 50 AS DOUBLE) / 10e0 - 2.5e0 AS dev, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 400 AS DOUBLE) / 10e0 END AS view_km2, c_custkey % 4 = 1 AS water_view,
        CAST((c_custkey * 37) % 720 AS DOUBLE) / 2e0 AS aspect_deg, CAST((c_custkey * 13) % 1000 AS DOUBLE) / 10e0 AS percentile, CAST((c_custkey * 29) % 4000 AS DOUBLE) - 1500e0 AS fetch_m FROM customer""",
    "tags": """SELECT p_partkey AS id, p_type, p_brand, p_size, p_name FROM part""",
}

SOURCES = {"lake_rings": "part", "parcel_rings": "supplier", "parcels": "supplier", "broken_rings": "part", "sites": "customer", "water": "part", "land": "nation", "vertices": "lineitem", "profile": "events", "fixes": "events", "edges": "lineitem", "routes": "orders", "grid": "part", "weather": "customer", "terrain": "customer", "tags": "part"}


#: Tables that don't grow.
FIXED = ("nation", "region")


def load(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A model table, or a driver table of that name. by is a column of a model table's source that its rows are dealt out by, once for all windows over it."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = SOURCES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    # The view's rows come from this one frame; its name never leaves this statement.
    table = spark.sql(re.sub(rf"\bFROM {source}\b", "FROM {source}", TABLES[name]), source=rows.repartition(by) if by else rows)
    return table if source in FIXED else dealt(table)


def sql(body: str, *names: str) -> str:
    """body with the model tables that it names in front, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + (", " if not body.lstrip().upper().startswith("SELECT") else " ") + body if names else body
