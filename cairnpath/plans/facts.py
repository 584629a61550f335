"""Queries that gather what is known of a site, a way or a route, and store it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.functions import curves
from cairnpath.operators import spatial
from cairnpath.plans.registry import query
from cairnpath.plans.scoring import TRAIL, UNITS, length_in, trail_distance
from cairnpath.plans.spatial import DIST, INSIDE, NEAR_TRAIL, SEGMENTS, parcels, site_counts
from cairnpath.sources.fixtures import load, sql


@query("usable_ways", sql("SELECT way_id, count(*) AS vertices, count(node_id) AS nodes FROM (SELECT way_id, CASE WHEN way_id % 9 = 0 AND pos = 2 THEN NULL ELSE node_id END AS node_id FROM vertices) GROUP BY way_id HAVING count(*) = count(node_id) AND count(*) >= 2", "vertices"))
def usable_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways with two nodes at least and a node for each vertex."""
    node = F.when(~((F.col("way_id") % 9 == 0) & (F.col("pos") == 2)), F.col("node_id"))
    return load(spark, d, "vertices").groupBy("way_id").agg(F.count(F.lit(1)).alias("vertices"), F.count(node).alias("nodes")).filter("vertices = nodes AND vertices >= 2")


@query("pruned_rows", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_size < 5)")
def pruned_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is left of stored rows once those go that a tightened filter leaves out."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size")
    return part.select("id").join(part.filter("p_type LIKE '%STEEL%' OR p_size < 5").select("id"), "id", "left_anti")


@query("zone_layers", sql("SELECT DISTINCT CASE WHEN z < 20 THEN 'cold-air' WHEN z < 60 THEN 'damp-ground' ELSE 'exposure' END AS layer FROM grid WHERE z IS NOT NULL AND ix >= 10", "grid"))
def zone_layers(spark: SparkSession, d: str) -> DataFrame:
    layer = F.when(F.col("z") < 20, "cold-air").when(F.col("z") < 60, "damp-ground").otherwise("exposure")
    return load(spark, d, "grid").filter("z IS NOT NULL AND ix >= 10").select(layer.alias("layer")).distinct()


@query("way_overlaps", sql("n AS (SELECT DISTINCT way_id, node_id FROM vertices), p AS (SELECT a.way_id, list_sort(list(a.node_id)) AS own FROM n a GROUP BY way_id) SELECT a.way_id, b.way_id AS next_id, array_to_string(list_sort(list_intersect(a.own, b.own)), ',') AS shared, len(list_filter(a.own, lambda x: NOT list_contains(b.own, x))) AS only_here FROM p a JOIN p b ON b.way_id = a.way_id + 1", "vertices"))
def way_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that a way shares with the next one by number, and how many it has alone; a way's nodes are one array."""
    nodes = load(spark, d, "vertices").groupBy("way_id").agg(F.collect_set("node_id").alias("own"))
    after = nodes.select((F.col("way_id") - 1).alias("way_id"), F.col("way_id").alias("next_id"), F.col("own").alias("other"))
    shared = F.array_sort(F.array_intersect("own", "other"))
    return nodes.join(after, "way_id").select("way_id", "next_id", F.array_join(F.transform(shared, lambda x: x.cast("string")), ",").alias("shared"), F.size(F.array_except("own", "other")).alias("only_here"))


@query("track_positions", sql(f"{SEGMENTS}, v AS (SELECT way_id, round(before_m, 1) AS at_m FROM runs UNION SELECT way_id, round(max(before_m + length_m), 1) FROM runs GROUP BY way_id), s AS (SELECT way_id, round(k * 250e0, 1) AS at_m FROM (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id), LATERAL (SELECT unnest(range(0, CAST(floor(way_m / 250) AS BIGINT) + 1)) AS k)) SELECT way_id, at_m FROM v UNION SELECT way_id, at_m FROM s", "vertices"))
def track_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where a track has points: at vertices and at samples every 250 m, each place of a tenth of a metre once."""
    c = F.col
    ways = spatial.segments(load(spark, d, "vertices")).groupBy("way_id").agg(F.collect_list("before_m").alias("at"), F.max(c("before_m") + c("length_m")).alias("end_m"), F.first("way_m").alias("way_m"))
    samples = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(c("way_m") / 250)), lambda k: k * 250.0)
    # A way's places are one short list, so none of them is a key of its own.
    places = F.array_distinct(F.transform(F.concat("at", F.array("end_m"), samples), lambda m: F.round(m, 1)))
    return ways.select("way_id", F.explode(places).alias("at_m"))


#: Fixed value: numbers of nodes that were added start here; one place of ten centimetres has one number.
ADDED = 5_000_000_000_000_000


def added_node(x: Column, y: Column) -> Column:
    return F.lit(ADDED) + F.bround(x * 10, 0).cast("long") * 100_000_000 + F.bround(y * 10, 0).cast("long")


@query("added_nodes", sql(f"SELECT site_id, {ADDED} + CAST(round_even(x_m * 10, 0) AS BIGINT) * 100000000 + CAST(round_even(y_m * 10, 0) AS BIGINT) AS node_id FROM sites", "sites"))
def added_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sites").select("site_id", added_node(F.col("x_m"), F.col("y_m")).alias("node_id"))


@query("vertex_at_node", sql("j AS (SELECT node_id FROM vertices GROUP BY node_id HAVING count(DISTINCT way_id) > 1), f AS (SELECT way_id, node_id, min(pos) AS pos FROM vertices GROUP BY way_id, node_id) SELECT f.way_id, f.node_id, round(v.x_m, 3) AS x_m, round(v.y_m, 3) AS y_m FROM f JOIN j USING (node_id) JOIN vertices v ON v.way_id = f.way_id AND v.pos = f.pos", "vertices"))
def vertex_at_node(spark: SparkSession, d: str) -> DataFrame:
    """The exact place of each junction on each of its ways: the first vertex with that node."""
    vertices = load(spark, d, "vertices")
    first = vertices.groupBy("way_id", "node_id").agg(F.min(F.struct("pos", "x_m", "y_m")).alias("v"))
    junctions = first.groupBy("node_id").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("node_id")
    return first.join(junctions, "node_id", "left_semi").select("way_id", "node_id", F.round("v.x_m", 3).alias("x_m"), F.round("v.y_m", 3).alias("y_m"))


@query("tile_pixels", sql("g AS (SELECT site_id, (-76e0 + x_m / 1e5 + 180) / 360 * 256 * 16384 AS x, (0.5 - ln((1 + sin(radians(43e0 + y_m / 1e5))) / (1 - sin(radians(43e0 + y_m / 1e5)))) / (4 * pi())) * 256 * 16384 AS y, site_id % 256 AS r, (site_id * 7) % 256 AS g, (site_id * 13) % 256 AS b FROM sites) SELECT site_id, CAST(floor(x / 256) AS BIGINT) AS tx, CAST(floor(y / 256) AS BIGINT) AS ty, round(x - floor(x / 256) * 256, 3) AS px, round(y - floor(y / 256) * 256, 3) AS py, r * 256e0 + g + b / 256e0 - 32768 AS elevation_m FROM g", "sites"))
def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The map tile and pixel of a place at zoom 14, and the height that a pixel's colours stand for."""
    lon, lat = F.lit(-76.0) + F.col("x_m") / 1e5, F.lit(43.0) + F.col("y_m") / 1e5
    scale, sin = 256.0 * 16384, F.sin(F.radians(lat))
    x, y = (lon + 180) / 360 * scale, (0.5 - F.log((1 + sin) / (1 - sin)) / (4 * F.pi())) * scale
    r, g, b = F.col("site_id") % 256, F.col("site_id") * 7 % 256, F.col("site_id") * 13 % 256
    tile = lambda v: F.floor(v / 256)
    return load(spark, d, "sites").select("site_id", tile(x).alias("tx"), tile(y).alias("ty"), F.round(x - tile(x) * 256, 3).alias("px"), F.round(y - tile(y) * 256, 3).alias("py"), (r * 256.0 + g + b / 256.0 - 32768).alias("elevation_m"))


def points_at(segments: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (way_id, at_m and more) with x_m and y_m, the place so far along the way; beyond its ends, the end."""
    c = F.col
    runs = segments.filter("length_m > 0").withColumn("last", F.max("pos").over(Window.partitionBy("way_id")) == c("pos")).withColumn("first", F.min("pos").over(Window.partitionBy("way_id")) == c("pos"))
    inside = ((c("at_m") >= c("before_m")) | c("first")) & ((c("at_m") < c("before_m") + c("length_m")) | c("last"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("at_m") - c("before_m")) / c("length_m")))
    on = marks.join(runs.drop("way_m"), "way_id").filter(inside)
    return on.select(*marks.columns, (c("ax") + (c("bx") - c("ax")) * t).alias("x_m"), (c("ay") + (c("by") - c("ay")) * t).alias("y_m"))


AT_SQL = "r AS (SELECT *, pos = max(pos) OVER (PARTITION BY way_id) AS is_last, pos = min(pos) OVER (PARTITION BY way_id) AS is_first FROM runs WHERE length_m > 0), placed AS (SELECT m.*, ax + (bx - ax) * greatest(0, least(1, (at_m - before_m) / length_m)) AS x, ay + (b_y - ay) * greatest(0, least(1, (at_m - before_m) / length_m)) AS y FROM marks m JOIN r ON r.way_id = m.way_id AND (at_m >= before_m OR is_first) AND (at_m < before_m + length_m OR is_last))"


@query("way_middles", sql(f"{SEGMENTS}, len AS (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id), marks AS (SELECT way_id, way_m, n, way_m / 2 + o AS at_m FROM len, (VALUES ('m', 0e0), ('a', -20e0), ('b', 20e0)) v(n, o) WHERE way_m > 0), {AT_SQL}, p AS (SELECT way_id, way_m, max(CASE WHEN n = 'm' THEN x END) AS x, max(CASE WHEN n = 'm' THEN y END) AS y, max(CASE WHEN n = 'b' THEN x END) - max(CASE WHEN n = 'a' THEN x END) AS dx, max(CASE WHEN n = 'b' THEN y END) - max(CASE WHEN n = 'a' THEN y END) AS dy FROM placed GROUP BY way_id, way_m) SELECT way_id, round(way_m, 2) AS way_m, round(x, 3) AS x_m, round(y, 3) AS y_m, round((degrees(atan2(dx, dy)) + 360) % 360, 3) AS bearing FROM p WHERE dx <> 0 OR dy <> 0", "vertices"))
def way_middles(spark: SparkSession, d: str) -> DataFrame:
    """The middle of each way, and its bearing from 20 m before it to 20 m after it."""
    segments, c = spatial.segments(load(spark, d, "vertices")), F.col
    ways = segments.groupBy("way_id").agg(F.first("way_m").alias("way_m")).filter("way_m > 0")
    marks = ways.select("way_id", "way_m", F.inline(F.array(*(F.struct(F.lit(n).alias("n"), (c("way_m") / 2 + o).alias("at_m")) for n, o in (("m", 0.0), ("a", -20.0), ("b", 20.0))))))
    pick = lambda n, v: F.max(F.when(c("n") == n, c(v)))
    lines = points_at(segments, marks).groupBy("way_id", "way_m").agg(pick("m", "x_m").alias("x"), pick("m", "y_m").alias("y"), (pick("b", "x_m") - pick("a", "x_m")).alias("dx"), (pick("b", "y_m") - pick("a", "y_m")).alias("dy"))
    return lines.filter("dx <> 0 OR dy <> 0").select("way_id", F.round("way_m", 2).alias("way_m"), F.round("x", 3).alias("x_m"), F.round("y", 3).alias("y_m"), F.round((F.degrees(F.atan2("dx", "dy")) + 360) % 360, 3).alias("bearing"))


@query("smoothed_bearings", sql(f"{SEGMENTS}, len AS (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id), marks AS (SELECT way_id, k, n, way_m / 2 + k / 8e0 * 400 + o AS at_m FROM len, range(-8, 9) r(k), (VALUES ('a', -20e0), ('b', 20e0)) v(n, o) WHERE way_m > 0), {AT_SQL}, p AS (SELECT way_id, k, max(CASE WHEN n = 'b' THEN x END) - max(CASE WHEN n = 'a' THEN x END) AS dx, max(CASE WHEN n = 'b' THEN y END) - max(CASE WHEN n = 'a' THEN y END) AS dy FROM placed GROUP BY way_id, k), s AS (SELECT way_id, sum(cos(atan2(dx, dy)) * (1 - abs(k) / 9e0)) AS north, sum(sin(atan2(dx, dy)) * (1 - abs(k) / 9e0)) AS east FROM p WHERE dx <> 0 OR dy <> 0 GROUP BY way_id) SELECT way_id, round((degrees(atan2(east, north)) + 360) % 360, 2) AS bearing FROM s WHERE abs(east) + abs(north) > 1e-6", "vertices"))
def smoothed_bearings(spark: SparkSession, d: str) -> DataFrame:
    """The circular mean of seventeen bearings within 400 m of each way's middle, those near it weighing more.

    A segment finds the marks that it holds by itself: there is no table of marks to be sorted and joined.
    """
    c, way = F.col, Window.partitionBy("way_id")
    runs = spatial.segments(load(spark, d, "vertices")).filter("way_m > 0 AND length_m > 0").withColumn("last", F.max("pos").over(way) == c("pos")).withColumn("first", F.min("pos").over(way) == c("pos"))
    marks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(sign).alias("sign"), F.lit(k / 8.0 * 400).alias("far"), F.lit(o).alias("o")) for k in range(-8, 9) for sign, o in ((-1, -20.0), (1, 20.0))))
    at = c("way_m") / 2 + c("far") + c("o")
    placed = runs.select("way_id", "way_m", "before_m", "length_m", "first", "last", "ax", "ay", "bx", "by", F.inline(marks)).withColumn("at_m", at)
    placed = placed.filter(((c("at_m") >= c("before_m")) | c("first")) & ((c("at_m") < c("before_m") + c("length_m")) | c("last")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("at_m") - c("before_m")) / c("length_m")))
    x, y = c("ax") + (c("bx") - c("ax")) * t, c("ay") + (c("by") - c("ay")) * t
    pick = lambda v, sign: F.max(F.when(c("sign") == sign, v))
    steps = placed.groupBy("way_id", "k").agg((pick(x, 1) - pick(x, -1)).alias("dx"), (pick(y, 1) - pick(y, -1)).alias("dy")).filter("dx <> 0 OR dy <> 0")
    angle, weight = F.atan2("dx", "dy"), 1 - F.abs("k") / 9.0
    means = steps.groupBy("way_id").agg(F.sum(F.cos(angle) * weight).alias("north"), F.sum(F.sin(angle) * weight).alias("east")).filter(F.abs("east") + F.abs("north") > 1e-6)
    return means.select("way_id", F.round((F.degrees(F.atan2("east", "north")) + 360) % 360, 2).alias("bearing"))


#: Submitted weights of users, some with an unknown factor, a negative number or nothing but zeros.
SENT = "CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'negative' WHEN 2 THEN 'zeros' ELSE 'fine' END"


@query("weight_overlays", f"SELECT user_id, state, CASE WHEN state = 'fine' THEN 0.5e0 END AS water, CASE WHEN state = 'fine' THEN (c % 7) / 10e0 END AS slope, CASE WHEN state = 'fine' THEN 0.3e0 END AS legal FROM (SELECT c_custkey AS user_id, c_custkey AS c, {SENT} AS state FROM customer)")
def weight_overlays(spark: SparkSession, d: str) -> DataFrame:
    """Defaults with a user's weights over them; unknown factors, numbers that aren't weights and all zeros are refused."""
    k = F.col("c_custkey")
    entry = lambda key, value: (F.lit(key), value)
    defaults = F.create_map(*(F.lit(x) for kv in curves.WEIGHTS.items() for x in kv))
    kind = F.expr(SENT)
    fine = F.create_map(*entry("water", F.lit(0.5)), *entry("slope", (k % 7) / 10.0))
    sent = F.when(kind == "unknown", F.create_map(F.lit("luck"), F.lit(1.0))).when(kind == "negative", F.create_map(F.lit("water"), F.lit(-1.0))).when(kind == "zeros", F.transform_values(defaults, lambda _, v: v * 0)).otherwise(fine)
    checked = load(spark, d, "customer").select(k.alias("user_id"), sent.alias("sent"), defaults.alias("defaults"))
    merged = F.map_zip_with("defaults", "sent", lambda _, own, new: F.coalesce(new, own))
    strange = F.size(F.array_except(F.map_keys("sent"), F.map_keys("defaults"))) > 0
    bad = F.exists(F.map_values("sent"), lambda v: (v < 0) | F.isnan(v) | (F.abs(v) == float("inf")))
    none = ~F.exists(F.map_values("merged"), lambda v: v > 0)
    state = F.when(strange, "unknown").when(bad, "negative").when(none, "zeros").otherwise("fine")
    out = checked.withColumn("merged", merged).withColumn("state", state)
    at = lambda f: F.when(F.col("state") == "fine", F.col("merged")[f]).alias(f)
    return out.select("user_id", "state", at("water"), at("slope"), at("legal"))


@query("rule_lengths", "SELECT p_partkey AS id, value, unit, round(CASE unit WHEN 'm' THEN value WHEN 'km' THEN value * 1000 WHEN 'ft' THEN value * 0.3048 ELSE value * 1609.344 END, 6) AS metres, CASE unit WHEN 'ft' THEN value ELSE round(value * CASE unit WHEN 'm' THEN 1 WHEN 'km' THEN 1000 ELSE 1609.344 END / 0.3048, 6) END AS feet FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, ['m', 'km', 'ft', 'mi'][p_partkey % 4 + 1] AS unit FROM part)")
def rule_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of rules in metres and feet; one that is in feet already stays exactly as it is."""
    unit = F.element_at(F.array(*(F.lit(u) for u in UNITS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    sized = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"), unit.alias("unit"))
    factor = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("unit")]
    feet = F.when(F.col("unit") == "ft", F.col("value")).otherwise(F.round(F.col("value") * factor / length_in((1.0, "ft"), "m"), 6))
    return sized.select("id", "value", "unit", F.round(F.col("value") * factor, 6).alias("metres"), feet.alias("feet"))


@query("placeholder_factors", sql("SELECT site_id, 'land_cover' AS factor, CAST(NULL AS DOUBLE) AS score, 'not_available' AS status FROM sites", "sites"))
def placeholder_factors(spark: SparkSession, d: str) -> DataFrame:
    """A factor that nothing evaluates yet: it has no score, and its weight counts for nothing."""
    return load(spark, d, "sites").select("site_id", F.lit("land_cover").alias("factor"), F.lit(None).cast("double").alias("score"), F.lit("not_available").alias("status"))


@query("same_names", "SELECT lower(p_name) AS name, count(*) AS parts, min(p_partkey) AS first_id FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE lower(p_name) END AS p_name FROM part) GROUP BY lower(p_name) HAVING count(*) > 1")
def same_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that are the same but for case."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.lower("p_name"))
    return load(spark, d, "part").groupBy(F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first_id")).filter("parts > 1")


#: Tags of a mapped site that are kept.
KEPT_TAGS = ("operator", "description", "tents", "fireplace", "openfire", "toilets", "drinking_water", "shower", "fee", "access", "dog", "camp_site", "caravans", "cabins")
RAW_TAGS = {
    "operator": "CASE site_id % 3 WHEN 0 THEN ' DEC ' END", "tents": "CASE site_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END", "toilets": "CASE site_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'pit' END",
    "shelter_type": "CASE site_id % 7 WHEN 0 THEN 'LEAN_TO' END", "amenity": "CASE site_id % 11 WHEN 0 THEN 'shelter' END", "colour": "'green'",
}


@query("site_tags", sql("SELECT site_id, concat_ws(';', CASE WHEN o IS NOT NULL THEN 'operator=' || trim(o) END, CASE WHEN t IS NOT NULL THEN 'tents=' || t END, CASE WHEN l <> '' THEN 'toilets=' || l END) AS tags, CASE WHEN s = 'LEAN_TO' OR a = 'shelter' THEN 'lean-to' WHEN lower(t) = 'yes' THEN 'tent site' ELSE '' END AS kind FROM (SELECT site_id, " + ", ".join(f"{e} AS {k[0] if k != 'toilets' else 'l'}" for k, e in RAW_TAGS.items() if k != "colour") + " FROM sites WHERE source = 'osm')", "sites"))
def site_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags of a mapped site that are kept, blank ones left out, and the kind of shelter that they tell of."""
    raw = F.map_filter(F.create_map(*(x for k, e in RAW_TAGS.items() for x in (F.lit(k), F.expr(e)))), lambda _, v: v.isNotNull())
    tagged = load(spark, d, "sites").filter("source = 'osm'").withColumn("raw", raw)
    at = lambda k: F.coalesce(F.col("raw")[k], F.lit(""))
    kept = F.filter(F.transform(F.array(*(F.lit(k) for k in KEPT_TAGS)), lambda k: F.struct(k.alias("k"), F.trim(F.col("raw")[k]).alias("v"))), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    kind = F.when((F.lower(at("shelter_type")) == "lean_to") | (at("amenity") == "shelter"), "lean-to").when(F.lower(at("tents")) == "yes", "tent site").otherwise("")
    return tagged.select("site_id", F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), ";").alias("tags"), kind.alias("kind"))


#: A site's own name, blank for every third; water and ways are named after their numbers.
OWN_NAME = "CASE WHEN site_id % 3 = 0 THEN ' ' || name || ' ' WHEN site_id % 3 = 1 THEN '  ' END"
NAMED = f"wn AS (SELECT site_id, {DIST} AS d, f.name AS nm FROM sites s JOIN water f ON abs(s.x_m - f.x_m) <= 1000 AND abs(s.y_m - f.y_m) <= 1000 WHERE {DIST} <= 1000 AND f.name IS NOT NULL), tn AS (SELECT site_id, d, 'Way ' || way_id AS nm FROM hits WHERE d <= 1000), near AS (SELECT site_id, min(struct_pack(d := round(d, 6), nm := nm)) AS b FROM (SELECT * FROM wn UNION ALL SELECT * FROM tn) GROUP BY site_id), ln AS (SELECT site_id, arg_min(l.name, struct_pack(a := (max_x - min_x) * (max_y - min_y), b := land_id)) AS land FROM sites s JOIN land l ON {INSIDE} GROUP BY site_id)"
DISPLAY = f"SELECT site_id, CASE WHEN trim(coalesce(own, '')) <> '' THEN trim(own) WHEN b IS NOT NULL THEN 'Campsite near ' || b.nm WHEN land IS NOT NULL THEN 'Campsite in ' || land ELSE '' END AS display_name, trim(coalesce(own, '')) = '' AND (b IS NOT NULL OR land IS NOT NULL) AS derived FROM (SELECT site_id, {OWN_NAME} AS own FROM sites) LEFT JOIN near USING (site_id) LEFT JOIN ln USING (site_id)"


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """site_id, display_name, derived: the source's name, or one from the nearest named water or way within 1 km, or from the land."""
    c, sites = F.col, load(spark, d, "sites")
    points = sites.select("site_id", "x_m", "y_m")
    first = lambda name: F.min(F.struct(F.round("distance_m", 6).alias("d"), name.alias("name"))).alias("near")
    named = spatial.dots(load(spark, d, "water").filter("name IS NOT NULL").select("x_m", "y_m", "name"))
    water = spatial.nearest_segment(points, named, ["site_id"], 1000.0, first(c("name"))).select("site_id", "near")
    ways = spatial.nearest_segment(points, spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), ["site_id"], 1000.0, first(F.concat(F.lit("Way "), "way_id"))).select("site_id", "near")
    near = water.unionByName(ways).groupBy("site_id").agg(F.min("near").alias("near"))
    area = (c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))
    land = parcels(spark, d).groupBy("site_id").agg(F.min_by("name", F.struct(area, "land_id")).alias("land"))
    own = F.trim(F.coalesce(F.expr(OWN_NAME), F.lit("")))
    named = sites.select("site_id", own.alias("own")).join(near, "site_id", "left").join(land, "site_id", "left")
    blank = c("own") == ""
    name = F.when(~blank, c("own")).when(c("near").isNotNull(), F.concat(F.lit("Campsite near "), "near.name")).when(c("land").isNotNull(), F.concat(F.lit("Campsite in "), "land")).otherwise("")
    return named.select("site_id", name.alias("display_name"), (blank & (c("near").isNotNull() | c("land").isNotNull())).alias("derived"))


@query("display_names", sql(f"{SEGMENTS}, {NEAR_TRAIL}, {NAMED} {DISPLAY}", "sites", "water", "vertices", "land"))
def display_names_query(spark: SparkSession, d: str) -> DataFrame:
    return display_names(spark, d)


@query("site_facts_upsert", sql(f"{SEGMENTS}, {NEAR_TRAIL}, {TRAIL}, {NAMED}, named AS ({DISPLAY}), old AS (SELECT site_id, 'old name' AS display_name, 1e0 AS trail_m, 1 AS version FROM sites WHERE site_id % 4 = 0), new AS (SELECT site_id, display_name, round(trail_m, 3) AS trail_m, 2 AS version FROM named LEFT JOIN trails USING (site_id) WHERE site_id % 3 <> 1) SELECT site_id, CASE WHEN new.version IS NULL THEN old.display_name ELSE new.display_name END AS display_name, CASE WHEN new.version IS NULL THEN old.trail_m ELSE new.trail_m END AS trail_m, coalesce(new.version, old.version) AS version FROM old FULL JOIN new USING (site_id)", "sites", "water", "vertices", "land"))
def site_facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Facts of sites worked out anew, over those that are stored; a stored row without a new one stays."""
    c = F.col
    old = load(spark, d, "sites").filter("site_id % 4 = 0").select("site_id", F.lit("old name").alias("old_name"), F.lit(1.0).alias("old_m"), F.lit(1).alias("old_version"))
    new = display_names(spark, d).join(trail_distance(spark, d), "site_id", "left").filter("site_id % 3 <> 1").select("site_id", c("display_name").alias("new_name"), F.round("trail_m", 3).alias("new_m"), F.lit(2).alias("new_version"))
    pick = lambda k: F.when(c("new_version").isNull(), c(f"old_{k}")).otherwise(c(f"new_{k}"))
    return old.join(new, "site_id", "full").select("site_id", pick("name").alias("display_name"), pick("m").alias("trail_m"), pick("version").alias("version"))


@query("route_facts_upsert", sql("old AS (SELECT route_id, -1e0 AS rating, DATE '2024-01-01' AS measured FROM routes WHERE route_id % 5 < 2), new AS (SELECT route_id, round(sqrt(gain_m * 3.280839895013123 * 2 * length_m / 1609.344), 3) AS rating, DATE '2024-06-01' AS measured FROM routes WHERE gain_m IS NOT NULL AND route_id % 3 = 0) SELECT route_id, coalesce(new.rating, old.rating) AS rating, CAST(coalesce(new.measured, old.measured) AS VARCHAR) AS measured FROM old FULL JOIN new USING (route_id)", "routes"))
def route_facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of routes that could be measured, over the stored ones."""
    routes = load(spark, d, "routes")
    old = routes.filter("route_id % 5 < 2").select("route_id", F.lit(-1.0).alias("old_rating"), F.lit("2024-01-01").alias("old_day"))
    rating = F.round(F.sqrt(F.col("gain_m") * 3.280839895013123 * 2 * F.col("length_m") / 1609.344), 3)
    new = routes.filter("gain_m IS NOT NULL AND route_id % 3 = 0").select("route_id", rating.alias("rating"), F.lit("2024-06-01").alias("day"))
    return old.join(new, "route_id", "full").select("route_id", F.coalesce("rating", "old_rating").alias("rating"), F.coalesce("day", "old_day").alias("measured"))


PLANNED = "CASE o_orderkey % 6 WHEN 0 THEN 'adk-north:naismith:10,-20' WHEN 1 THEN 'adk:distance:1,2,3' WHEN 2 THEN 'ADK:naismith:1,2' WHEN 3 THEN 'adk:naismith:7' WHEN 4 THEN 'adk:quick:1,2' ELSE 'adk:naismith:1,2,' END"


@query("planned_route_ids", f"SELECT id, CASE WHEN fine THEN split_part(v, ':', 1) END AS region, CASE WHEN fine THEN split_part(v, ':', 2) END AS cost, CASE WHEN fine THEN len(string_split(split_part(v, ':', 3), ',')) END AS stops, fine FROM (SELECT o_orderkey AS id, {PLANNED} AS v, o_orderkey % 6 < 2 AS fine FROM orders)")
def planned_route_ids(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a planned route's id: region, cost and two to ten stops; anything else isn't one."""
    planned = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(PLANNED).alias("v"))
    fine = F.rlike("v", F.lit(r"^[a-z0-9-]+:(naismith|distance):-?[0-9]+(,-?[0-9]+){1,9}$"))
    part = lambda k: F.when(fine, F.split_part("v", F.lit(":"), F.lit(k)))
    return planned.select("id", part(1).alias("region"), part(2).alias("cost"), F.when(fine, F.size(F.split(part(3), ","))).cast("long").alias("stops"), fine.alias("fine"))


@query("filter_params", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 4 = 2 THEN NULL ELSE CAST(CAST(round((c_custkey % 50) * 1609.344e0) AS BIGINT) AS VARCHAR) END AS min_length_m, CASE WHEN c_custkey % 2 = 0 THEN 'hard,moderate' END AS difficulty FROM customer")
def filter_params(spark: SparkSession, d: str) -> DataFrame:
    """A filter form as parameters: miles as whole metres, blanks and what is no length left out, choices in order."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "far").when(k % 4 == 2, "-3").otherwise((k % 50).cast("string"))
    value = raw.try_cast("double")
    metres = F.when(value >= 0, F.round(value * 1609.344).cast("long").cast("string"))
    chosen = F.when(k % 2 == 0, F.array(F.lit("moderate"), F.lit("hard"))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "customer").select(k.alias("id"), metres.alias("min_length_m"), F.when(F.size(chosen) > 0, F.array_join(F.array_sort(chosen), ",")).alias("difficulty"))


@query("run_records", "SELECT source, accepted, rejected, CASE WHEN accepted = 0 THEN 'FAILED' WHEN rejected > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, examples FROM (SELECT p_brand AS source, count(*) FILTER (p_size >= 10) AS accepted, count(*) FILTER (p_size < 10) AS rejected, array_to_string(list_slice(list_sort(list(p_partkey) FILTER (p_size < 10)), 1, 3), ',') AS examples FROM part GROUP BY p_brand)")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    """How each source's run ended: what was accepted, what wasn't, and three examples of it."""
    small, c = F.col("p_size") < 10, F.col
    part = load(spark, d, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    few = part.filter(small).withColumn("k", rank).filter("k <= 3").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("examples"))
    runs = part.groupBy("p_brand").agg(F.count_if(~small).alias("accepted"), F.count_if(small).alias("rejected")).join(few, "p_brand", "left")
    status = F.when(c("accepted") == 0, "FAILED").when(c("rejected") > 0, "PARTIAL").otherwise("SUCCESS")
    return runs.select(c("p_brand").alias("source"), "accepted", "rejected", status.alias("status"), "examples")


@query("tile_union", sql("t AS (SELECT site_id, CAST(floor(x_m / 25000) AS BIGINT) AS i, x_m - floor(x_m / 25000) * 25000 AS dx FROM sites), r AS (SELECT site_id, i FROM t UNION ALL SELECT site_id, i - 1 FROM t WHERE dx < 2000 AND i > 0) SELECT site_id, min(i) AS tile, count(*) AS delivered FROM r GROUP BY site_id", "sites"))
def tile_union(spark: SparkSession, d: str) -> DataFrame:
    """Records of overlapping tiles read one after another; of one that two deliver, the first tile's stays."""
    sites, c = load(spark, d, "sites"), F.col
    tiles = [sites.filter((c("x_m") >= i * 25000.0) & (c("x_m") < (i + 1) * 25000.0 + (2000.0 if i < 3 else 1e9))).select("site_id", F.lit(i).cast("long").alias("tile")) for i in range(4)]
    union = tiles[0].unionByName(tiles[1]).unionByName(tiles[2]).unionByName(tiles[3])
    return union.groupBy("site_id").agg(F.min("tile").alias("tile"), F.count(F.lit(1)).alias("delivered"))


@query("clipped_ways", sql(f"{SEGMENTS}, box AS (SELECT 20000e0 AS min_x, 60000e0 AS max_x, 10000e0 AS min_y, 70000e0 AS max_y), cut AS (SELECT runs.*, greatest(0e0, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN min_x AND max_x THEN 0e0 ELSE 2e0 END ELSE least((min_x - ax) / (bx - ax), (max_x - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN CASE WHEN ay BETWEEN min_y AND max_y THEN 0e0 ELSE 2e0 END ELSE least((min_y - ay) / (b_y - ay), (max_y - ay) / (b_y - ay)) END) AS t0, least(1e0, CASE WHEN bx = ax THEN 1e0 ELSE greatest((min_x - ax) / (bx - ax), (max_x - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN 1e0 ELSE greatest((min_y - ay) / (b_y - ay), (max_y - ay) / (b_y - ay)) END) AS t1 FROM runs, box), k AS (SELECT *, coalesce(t0 > 0 OR lag(t1) OVER w < 1 OR lag(pos) OVER w <> pos - 1, TRUE) AS fresh FROM cut WHERE t0 < t1 WINDOW w AS (PARTITION BY way_id ORDER BY pos)), p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY way_id ORDER BY pos) AS part FROM k) SELECT way_id, CAST(part AS BIGINT) AS part, count(*) AS segments, round(sum((t1 - t0) * length_m), 3) AS length_m FROM p GROUP BY way_id, part", "vertices"))
def clipped_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways cut to a viewport: the parts inside, each a line of its own."""
    c, w = F.col, Window.partitionBy("way_id").orderBy("pos")
    t0, t1 = spatial.clip_to_box(*(c(k) for k in ("ax", "ay", "bx", "by")), *(F.lit(v) for v in (20000.0, 60000.0, 10000.0, 70000.0)))
    inside = spatial.segments(load(spark, d, "vertices")).withColumn("t0", t0).withColumn("t1", t1).filter("t0 < t1")
    fresh = F.coalesce((c("t0") > 0) | (F.lag("t1").over(w) < 1) | (F.lag("pos").over(w) != c("pos") - 1), F.lit(True))
    parts = inside.withColumn("part", F.sum(fresh.cast("int")).over(w))
    return parts.groupBy("way_id", "part").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum((c("t1") - c("t0")) * c("length_m")), 3).alias("length_m"))


def clip_rings(corners: DataFrame, key: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rings as rows (key, i, x, y; not closed) cut to a box, side by side; right for convex rings, whose cut is one ring."""
    c = F.col
    for axis, limit, below in (("x", low[0], False), ("x", high[0], True), ("y", low[1], False), ("y", high[1], True)):
        ring = Window.partitionBy(key).orderBy("i")
        before = F.coalesce(F.lag(F.struct("x", "y")).over(ring), F.last(F.struct("x", "y")).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        inside = lambda v: v <= limit if below else v >= limit  # noqa: E731,B023
        t = (F.lit(limit) - c("p")[axis]) / (c(axis) - c("p")[axis])
        crossing = F.struct((c("p.x") + t * (c("x") - c("p.x"))).alias("x"), (c("p.y") + t * (c("y") - c("p.y"))).alias("y"))
        here, was = inside(c(axis)), inside(c("p")[axis])
        own = F.array(F.struct(c("x").alias("x"), c("y").alias("y")))
        points = F.when(here & was, own).when(here, F.concat(F.array(crossing), own)).when(was, F.array(crossing))
        cut = corners.withColumn("p", before).select(key, "i", F.posexplode(points).alias("k", "q"))
        corners = cut.select(key, (c("i") * 2 + c("k")).alias("i"), "q.x", "q.y")
    return corners


def ring_areas(corners: DataFrame, key: str) -> DataFrame:
    """The area of each ring, by the cross products of its corners with the next ones."""
    ring = Window.partitionBy(key).orderBy("i")
    after = F.coalesce(F.lead(F.struct("x", "y")).over(ring), F.first(F.struct("x", "y")).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    crossed = corners.withColumn("n", after).withColumn("part", F.col("x") * F.col("n.y") - F.col("n.x") * F.col("y"))
    return crossed.groupBy(key).agg((F.abs(F.sum("part")) / 2).alias("area"))


@query("clipped_land", sql("SELECT land_id, round(greatest(0, least(max_x, 60000) - greatest(min_x, 20000)) * greatest(0, least(max_y, 70000) - greatest(min_y, 10000)), 2) AS area_m2 FROM land", "land"))
def clipped_land(spark: SparkSession, d: str) -> DataFrame:
    """The area of each parcel's ring that is in a viewport."""
    at = lambda i, x, y: F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    land = load(spark, d, "land")
    corners = land.select("land_id", F.inline(F.array(at(0, "min_x", "min_y"), at(1, "max_x", "min_y"), at(2, "max_x", "max_y"), at(3, "min_x", "max_y"))))
    areas = ring_areas(clip_rings(corners, "land_id", (20000.0, 10000.0), (60000.0, 70000.0)), "land_id")
    return land.select("land_id").join(areas, "land_id", "left").select("land_id", F.round(F.coalesce("area", F.lit(0.0)), 2).alias("area_m2"))


@query("user_points_near", sql(f"{SEGMENTS}, {NEAR_TRAIL.replace('5000', '250')} SELECT way_id, count(DISTINCT site_id) AS points, min(site_id) AS first_id FROM hits WHERE d <= 250 GROUP BY way_id", "sites", "vertices"))
def user_points_near(spark: SparkSession, d: str) -> DataFrame:
    """Points within 250 m of each way; they are counted where they meet, so that counts are summed and no pairs dealt out."""
    return site_counts(spark, d, 250.0).select("way_id", "points", "first_id")
