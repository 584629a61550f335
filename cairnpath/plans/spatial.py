"""Queries of nearest, surrounding and containing features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.functions.curves import FEATURE, FLOW, lookup, peak_curve
from cairnpath.operators import pairs, spatial
from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import load, sql

DIST = "sqrt((s.x_m - f.x_m) * (s.x_m - f.x_m) + (s.y_m - f.y_m) * (s.y_m - f.y_m))"
CURVE = "CASE WHEN d <= 60 THEN 35 + 65 * d / 60 ELSE 100 * pow(0.5e0, (d - 60) / 400) END"
#: Sites, water within 3 km of each and its rank in its flow class.
RANKED = f"""near AS (SELECT site_id, water_id, feature_type, perennial, {DIST} AS d, CASE WHEN perennial THEN 'perennial' WHEN NOT perennial THEN 'intermittent' ELSE 'unknown' END AS flow
        FROM sites s JOIN water f ON abs(s.x_m - f.x_m) <= 3000 AND abs(s.y_m - f.y_m) <= 3000 WHERE {DIST} <= 3000),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, flow ORDER BY d, water_id) AS rk FROM near),
    scored AS (SELECT *, {CURVE} * CASE flow WHEN 'perennial' THEN 1.0e0 WHEN 'unknown' THEN 0.8e0 ELSE 0.55e0 END
        * CASE feature_type WHEN 'wetland' THEN 0.5e0 WHEN 'other' THEN 0.7e0 ELSE 1.0e0 END AS sc FROM ranked WHERE rk <= 5),
    best AS (SELECT site_id, round(max(sc), 4) AS water_score, arg_max(water_id, struct_pack(a := round(sc, 6), b := -water_id)) AS best_water_id,
        round(arg_max(d, struct_pack(a := round(sc, 6), b := -water_id)), 4) AS distance_m, round(min(d), 4) AS nearest_any_m FROM scored GROUP BY site_id)"""


def flow_class() -> F.Column:
    return F.when(F.col("perennial"), "perennial").when(~F.col("perennial"), "intermittent").otherwise("unknown")


def water_factor(sites: DataFrame, water: DataFrame) -> DataFrame:
    """The best of the five nearest features of each flow class, and the nearest of all; sites without water have a score of 0."""
    classed = water.withColumn("flow", flow_class()).drop("name")
    near = spatial.nearest_k(sites.select("site_id", "x_m", "y_m"), classed, "site_id", "water_id", 5, 3000.0, ["flow"])
    d = F.col("distance_m")
    scored = near.withColumn("sc", peak_curve(d, 60.0, 35.0, 400.0) * lookup(F.col("flow"), FLOW, 0.8) * lookup(F.col("feature_type"), FEATURE, 0.7))
    rank = F.struct(F.round("sc", 6), -F.col("water_id"))
    best = scored.groupBy("site_id").agg(F.round(F.max("sc"), 4).alias("water_score"), F.max_by("water_id", rank).alias("best_water_id"), F.round(F.max_by(d, rank), 4).alias("distance_m"), F.round(F.min(d), 4).alias("nearest_any_m"))
    return sites.select("site_id").join(best, "site_id", "left").withColumn("water_score", F.coalesce("water_score", F.lit(0.0)))


@query("site_water_score", sql(RANKED + " SELECT site_id, coalesce(water_score, 0) AS water_score, best_water_id, distance_m, nearest_any_m FROM sites LEFT JOIN best USING (site_id)", "sites", "water"))
def site_water_score(spark: SparkSession, d: str) -> DataFrame:
    return water_factor(load(spark, d, "sites"), load(spark, d, "water"))


@query("nearest_water", sql(f"r AS (SELECT site_id, water_id, {DIST} AS d, row_number() OVER (PARTITION BY site_id ORDER BY {DIST}, water_id) AS k FROM sites s, water f) SELECT site_id, water_id, round(d, 4) AS distance_m FROM r WHERE k = 1", "sites", "water"))
def nearest_water(spark: SparkSession, d: str) -> DataFrame:
    """The nearest water of each site, however far it is."""
    near = spatial.nearest_k(load(spark, d, "sites").select("site_id", "x_m", "y_m"), load(spark, d, "water"), "site_id", "water_id", 1)
    return near.select("site_id", "water_id", F.round("distance_m", 4).alias("distance_m"))


@query("nearest_k_perennial", sql(f"r AS (SELECT site_id, water_id, {DIST} AS d, row_number() OVER (PARTITION BY site_id ORDER BY {DIST}, water_id) AS rank FROM sites s, water f WHERE perennial) SELECT site_id, water_id, rank, round(d, 4) AS distance_m FROM r WHERE rank <= 3", "sites", "water"))
def nearest_k_perennial(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest_k(load(spark, d, "sites").select("site_id", "x_m", "y_m"), load(spark, d, "water").filter("perennial"), "site_id", "water_id", 3)
    return near.select("site_id", "water_id", F.col("rank").cast("long").alias("rank"), F.round("distance_m", 4).alias("distance_m"))


@query("water_within", sql(f"SELECT site_id, water_id, round({DIST}, 4) AS distance_m FROM sites s JOIN water f ON {DIST} <= 1500", "sites", "water"))
def water_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(load(spark, d, "sites").select("site_id", "x_m", "y_m"), load(spark, d, "water").drop("name"), 1500.0).select("site_id", "water_id", F.round("distance_m", 4).alias("distance_m"))


@query("sites_near_water", sql(f"SELECT site_id FROM sites s WHERE EXISTS (SELECT 1 FROM water f WHERE {DIST} <= 1000)", "sites", "water"))
def sites_near_water(spark: SparkSession, d: str) -> DataFrame:
    sites = load(spark, d, "sites").select("site_id", "x_m", "y_m")
    return sites.join(spatial.within(sites, load(spark, d, "water"), 1000.0), "site_id", "left_semi").select("site_id")


@query("sites_off_water", sql(f"SELECT site_id FROM sites s WHERE NOT EXISTS (SELECT 1 FROM water f WHERE {DIST} <= 1000)", "sites", "water"))
def sites_off_water(spark: SparkSession, d: str) -> DataFrame:
    sites = load(spark, d, "sites").select("site_id", "x_m", "y_m")
    return sites.join(spatial.within(sites, load(spark, d, "water"), 1000.0), "site_id", "left_anti").select("site_id")


INSIDE = "x_m >= min_x AND x_m <= max_x AND y_m >= min_y AND y_m <= max_y"
STRICT = "CASE access WHEN 'closed' THEN 0 WHEN 'restricted' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END"


def strictness() -> F.Column:
    return F.when(F.col("access") == "closed", 0).when(F.col("access") == "restricted", 1).when(F.col("access") == "unknown", 2).otherwise(3)


def parcels(spark: SparkSession, d: str, sites: DataFrame | None = None) -> DataFrame:
    points = load(spark, d, "sites") if sites is None else sites
    return spatial.in_boxes(points.select("site_id", "x_m", "y_m"), load(spark, d, "land"), 10000.0)


def land_by_site(inside: DataFrame) -> DataFrame:
    """The strictest access at each site, the best protection among the parcels that set it, and all their names."""
    rank = F.struct(strictness(), F.coalesce("gap", F.lit("9")), "land_id")
    return inside.groupBy("site_id").agg(F.min_by("access", rank).alias("access"), F.min_by("gap", rank).alias("gap"), F.count(F.lit(1)).alias("parcels"), F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("land_names"))


@query("land_at_site", sql(f"SELECT site_id, arg_min(access, struct_pack(a := {STRICT}, b := coalesce(gap, '9'), c := land_id)) AS access, nullif(arg_min(coalesce(gap, ''), struct_pack(a := {STRICT}, b := coalesce(gap, '9'), c := land_id)), '') AS gap, count(*) AS parcels, string_agg(l.name, '; ' ORDER BY l.name) AS land_names FROM sites s JOIN land l ON {INSIDE} GROUP BY site_id", "sites", "land"))
def land_at_site(spark: SparkSession, d: str) -> DataFrame:
    return land_by_site(parcels(spark, d))


@query("smallest_land", sql(f"SELECT site_id, arg_min(land_id, struct_pack(a := (max_x - min_x) * (max_y - min_y), b := land_id)) AS land_id, round(min((max_x - min_x) * (max_y - min_y)), 2) AS area_m2 FROM sites s JOIN land l ON {INSIDE} GROUP BY site_id", "sites", "land"))
def smallest_land(spark: SparkSession, d: str) -> DataFrame:
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return parcels(spark, d).groupBy("site_id").agg(F.min_by("land_id", F.struct(area, "land_id")).alias("land_id"), F.round(F.min(area), 2).alias("area_m2"))


@query("zone_class_at_site", sql(f"SELECT site_id, min(gap) AS zone_class FROM sites s JOIN land l ON {INSIDE} AND gap IS NOT NULL GROUP BY site_id", "sites", "land"))
def zone_class_at_site(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).filter("gap IS NOT NULL").groupBy("site_id").agg(F.min("gap").alias("zone_class"))


@query("sites_in_closed_land", sql(f"SELECT site_id FROM sites s WHERE EXISTS (SELECT 1 FROM land l WHERE {INSIDE} AND access = 'closed')", "sites", "land"))
def sites_in_closed_land(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sites").join(parcels(spark, d).filter("access = 'closed'"), "site_id", "left_semi").select("site_id")


HEX = [(0.0, 0.5), (0.25, 0.0), (0.75, 0.0), (1.0, 0.5), (0.75, 1.0), (0.25, 1.0)]


@query(
    "sites_in_hexagons",
    sql(
        "sides AS (SELECT land_id, min_x + (max_x - min_x) * ax AS ax, min_y + (max_y - min_y) * ay AS ay, min_x + (max_x - min_x) * bx AS bx, min_y + (max_y - min_y) * b_y AS b_y FROM land, (VALUES "
        + ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(HEX, HEX[1:] + HEX[:1], strict=True))
        + ") v(ax, ay, bx, b_y)) SELECT site_id, land_id FROM sites, sides WHERE (ay > y_m) <> (b_y > y_m) AND x_m < (bx - ax) * (y_m - ay) / (b_y - ay) + ax GROUP BY site_id, land_id HAVING count(*) % 2 = 1",
        "sites",
        "land",
    ),
)
def sites_in_hexagons(spark: SparkSession, d: str) -> DataFrame:
    at = lambda fx, fy: F.struct((F.col("min_x") + (F.col("max_x") - F.col("min_x")) * fx).alias("x"), (F.col("min_y") + (F.col("max_y") - F.col("min_y")) * fy).alias("y"))
    ring = F.array(*(at(*p) for p in [*HEX, HEX[0]]))
    return parcels(spark, d).filter(spatial.in_ring(F.col("x_m"), F.col("y_m"), ring)).select("site_id", "land_id")


SEGMENTS = """seg AS (SELECT way_id, pos, x_m AS ax, y_m AS ay, lead(x_m) OVER (PARTITION BY way_id ORDER BY pos) AS bx, lead(y_m) OVER (PARTITION BY way_id ORDER BY pos) AS b_y FROM vertices),
    segs AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS length_m FROM seg WHERE bx IS NOT NULL),
    runs AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_m FROM segs)"""
NEAR_SEG = """hits AS (SELECT *, sqrt((x_m - (ax + t * (bx - ax))) * (x_m - (ax + t * (bx - ax))) + (y_m - (ay + t * (b_y - ay))) * (y_m - (ay + t * (b_y - ay)))) AS d FROM (
        SELECT *, CASE WHEN length_m = 0 THEN 0 ELSE least(1e0, greatest(0e0, ((x_m - ax) * (bx - ax) + (y_m - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) END AS t
        FROM sites JOIN runs ON x_m BETWEEN least(ax, bx) - 1000 AND greatest(ax, bx) + 1000 AND y_m BETWEEN least(ay, b_y) - 1000 AND greatest(ay, b_y) + 1000))"""


#: The same within 5 km of a way, which is as far as a trail counts.
NEAR_TRAIL = NEAR_SEG.replace("1000", "5000")


@query("nearest_segment", sql(f"{SEGMENTS}, {NEAR_SEG} SELECT site_id, arg_min(way_id, struct_pack(a := round(d, 6), b := way_id, c := pos)) AS way_id, round(min(d), 4) AS distance_m, round(arg_min(before_m + t * length_m, struct_pack(a := round(d, 6), b := way_id, c := pos)), 3) AS along_m FROM hits WHERE d <= 1000 GROUP BY site_id", "sites", "vertices"))
def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    rank = F.struct(F.round("distance_m", 6), "way_id", "pos")
    first = [F.min_by("way_id", rank).alias("way_id"), F.min_by(F.col("before_m") + F.col("t") * F.col("length_m"), rank).alias("along_m")]
    near = spatial.nearest_segment(load(spark, d, "sites").select("site_id", "x_m", "y_m"), spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), ["site_id"], 1000.0, *first)
    return near.select("site_id", "way_id", F.round("least_m", 4).alias("distance_m"), F.round("along_m", 3).alias("along_m"))


ALONG = f"{SEGMENTS}, {NEAR_SEG}, along AS (SELECT site_id, way_id, min(d) AS off_m, arg_min(before_m + t * length_m, struct_pack(a := round(d, 6), b := pos)) AS along_m FROM hits WHERE d <= 500 GROUP BY site_id, way_id), len AS (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id)"


def along_ways(spark: SparkSession, d: str) -> DataFrame:
    return pairs.near_ways(load(spark, d, "sites").select("site_id", "x_m", "y_m"), spatial.segments(load(spark, d, "vertices", "l_orderkey")), load(spark, d, "vertices"), "site_id", 500.0)


def site_counts(spark: SparkSession, d: str, metres: float) -> DataFrame:
    return pairs.near_counts(load(spark, d, "sites").select("site_id", "x_m", "y_m"), spatial.segments(load(spark, d, "vertices", "l_orderkey")), load(spark, d, "vertices"), "site_id", metres)


@query("sites_along_ways", sql(ALONG + " SELECT site_id, way_id, round(off_m, 4) AS off_m, round(along_m, 3) AS along_m, CASE WHEN off_m > 100 AND along_m <= 50 THEN 'near_start' WHEN off_m > 100 AND along_m >= way_m - 50 THEN 'near_end' ELSE 'along' END AS position FROM along JOIN len USING (way_id)", "sites", "vertices"))
def sites_along_ways(spark: SparkSession, d: str) -> DataFrame:
    off, along = F.col("off_m"), F.col("along_m")
    where = F.when((off > 100) & (along <= 50), "near_start").when((off > 100) & (along >= F.col("way_m") - 50), "near_end").otherwise("along")
    return along_ways(spark, d).select("site_id", "way_id", pairs.rounded(off, 4).alias("off_m"), pairs.rounded(along, 3).alias("along_m"), where.alias("position"))


@query("site_counts_by_way", sql(ALONG + " SELECT way_id, count(site_id) AS sites, round(min(off_m), 4) AS nearest_m FROM len LEFT JOIN along USING (way_id) GROUP BY way_id", "sites", "vertices"))
def site_counts_by_way(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    counts = site_counts(spark, d, 500.0).select("way_id", c("points").alias("sites"), F.round("least_m", 4).alias("nearest_m"))
    ways = load(spark, d, "vertices").groupBy("way_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("way_id")
    return ways.join(counts, "way_id", "left").withColumn("sites", F.coalesce("sites", F.lit(0)))


@query("sites_within_2km", sql(f"{SEGMENTS}, {NEAR_SEG.replace('1000', '2000')}, len AS (SELECT DISTINCT way_id FROM segs) SELECT way_id, count(DISTINCT site_id) AS sites FROM len LEFT JOIN (SELECT way_id, site_id FROM hits WHERE d <= 2000) USING (way_id) GROUP BY way_id", "sites", "vertices"))
def sites_within_2km(spark: SparkSession, d: str) -> DataFrame:
    """How many sites are within 2 km of each way, none included."""
    ways = load(spark, d, "vertices").groupBy("way_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("way_id")
    return ways.join(site_counts(spark, d, 2000.0), "way_id", "left").select("way_id", F.coalesce("points", F.lit(0)).alias("sites"))


@query("snap_candidates", sql(f"{SEGMENTS}, {NEAR_SEG}, best AS (SELECT site_id, way_id, min(d) AS d FROM hits WHERE d <= 1000 GROUP BY site_id, way_id), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(d, 6), way_id) AS rank FROM best) SELECT site_id, way_id, rank, round(d, 4) AS distance_m FROM r WHERE rank <= 4", "sites", "vertices"))
def snap_candidates(spark: SparkSession, d: str) -> DataFrame:
    best = spatial.nearest_ways(load(spark, d, "sites").select("site_id", "x_m", "y_m"), spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), "site_id", "way_id", 4, 1000.0)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.round("d", 6), "way_id")).cast("long")
    return best.withColumn("rank", rank).filter("rank <= 4").select("site_id", "way_id", "rank", F.round("d", 4).alias("distance_m"))


CLIP = f"""{SEGMENTS}, cut AS (SELECT way_id, land_id, before_m, length_m,
        greatest(0e0, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN min_x AND max_x THEN 0e0 ELSE 2e0 END ELSE least((min_x - ax) / (bx - ax), (max_x - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN CASE WHEN ay BETWEEN min_y AND max_y THEN 0e0 ELSE 2e0 END ELSE least((min_y - ay) / (b_y - ay), (max_y - ay) / (b_y - ay)) END) AS t0,
        least(1e0, CASE WHEN bx = ax THEN 1e0 ELSE greatest((min_x - ax) / (bx - ax), (max_x - ax) / (bx - ax)) END, CASE WHEN b_y = ay THEN 1e0 ELSE greatest((min_y - ay) / (b_y - ay), (max_y - ay) / (b_y - ay)) END) AS t1
        FROM runs, land WHERE greatest(ax, bx) >= min_x AND least(ax, bx) <= max_x AND greatest(ay, b_y) >= min_y AND least(ay, b_y) <= max_y),
    pieces AS (SELECT way_id, land_id, before_m + t0 * length_m AS from_m, before_m + t1 * length_m AS to_m FROM cut WHERE t0 < t1)"""


def stretches(spark: SparkSession, d: str) -> DataFrame:
    """The parts of ways in land, as running lengths; a segment and a parcel that share many cells count in the first of them."""
    size, c = 10000.0, F.col
    low = lambda x: F.floor(x / size)
    put = lambda df, x0, x1, y0, y1, n: df.withColumn("cell_x", spatial.around(x0, x1, size)).withColumn("cell_y", spatial.around(y0, y1, size)).withColumn(f"{n}_x", low(x0)).withColumn(f"{n}_y", low(y0))
    segments = put(spatial.segments(load(spark, d, "vertices")), F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by"), "seg")
    land = put(load(spark, d, "land"), c("min_x"), c("max_x"), c("min_y"), c("max_y"), "land")
    met = segments.join(land, ["cell_x", "cell_y"]).filter((c("cell_x") == F.greatest("seg_x", "land_x")) & (c("cell_y") == F.greatest("seg_y", "land_y")))
    t0, t1 = spatial.clip_to_box(*(c(x) for x in ("ax", "ay", "bx", "by", "min_x", "max_x", "min_y", "max_y")))
    return met.withColumn("t0", t0).withColumn("t1", t1).filter("t0 < t1").select("way_id", "land_id", "access", (c("before_m") + c("t0") * c("length_m")).alias("from_m"), (c("before_m") + c("t1") * c("length_m")).alias("to_m"))


def merged(pieces: DataFrame, keys: list[str], gap: float = 1.0) -> DataFrame:
    """Intervals no more than a gap apart made one."""
    order = Window.partitionBy(*keys).orderBy("from_m", "to_m")
    reach = F.max("to_m").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("fresh", F.when(F.col("from_m") <= reach + gap, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy(*keys, "island").agg(F.min("from_m").alias("from_m"), F.max("to_m").alias("to_m"))


MERGE = "marked AS (SELECT *, CASE WHEN from_m <= max(to_m) OVER (PARTITION BY way_id, land_id ORDER BY from_m, to_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM pieces), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY way_id, land_id ORDER BY from_m, to_m ROWS UNBOUNDED PRECEDING) AS island FROM marked), parts AS (SELECT way_id, land_id, island, min(from_m) AS from_m, max(to_m) AS to_m FROM isl GROUP BY ALL)"


@query("way_stretches", sql(f"{CLIP}, {MERGE} SELECT way_id, land_id, round(from_m, 2) AS from_m, round(to_m, 2) AS to_m FROM parts", "vertices", "land"))
def way_stretches(spark: SparkSession, d: str) -> DataFrame:
    return merged(stretches(spark, d), ["way_id", "land_id"]).select("way_id", "land_id", F.round("from_m", 2).alias("from_m"), F.round("to_m", 2).alias("to_m"))


@query("way_access_totals", sql(f"{CLIP}, {MERGE}, kinds AS (SELECT DISTINCT access FROM land), len AS (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id), tot AS (SELECT way_id, access, sum(to_m - from_m) AS m FROM parts JOIN land USING (land_id) GROUP BY ALL) SELECT len.way_id, kinds.access, round(coalesce(m, 0), 1) AS metres, coalesce(round(100 * coalesce(m, 0) / nullif(way_m, 0), 2), 0) AS share_pct FROM len CROSS JOIN kinds LEFT JOIN tot ON tot.way_id = len.way_id AND tot.access = kinds.access", "vertices", "land"))
def way_access_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = merged(stretches(spark, d), ["way_id", "land_id", "access"]).groupBy("way_id", "access").agg(F.sum(F.col("to_m") - F.col("from_m")).alias("m"))
    lengths = spatial.segments(load(spark, d, "vertices")).groupBy("way_id").agg(F.sum("length_m").alias("way_m"))
    kinds = F.array(*(F.lit(k) for k in ("open", "restricted", "unknown", "closed")))
    metres = F.coalesce("m", F.lit(0.0))
    share = F.when(F.col("way_m") > 0, F.round(100 * metres / F.col("way_m"), 2)).otherwise(0.0)
    return lengths.withColumn("access", F.explode(kinds)).join(totals, ["way_id", "access"], "left").select("way_id", "access", F.round(metres, 1).alias("metres"), share.alias("share_pct"))


@query("way_connections", sql("n AS (SELECT DISTINCT way_id, node_id FROM vertices) SELECT a.way_id, b.way_id AS other_id, count(*) AS shared_nodes, min(a.node_id) AS first_node FROM n a JOIN n b ON a.node_id = b.node_id AND a.way_id < b.way_id GROUP BY ALL", "vertices"))
def way_connections(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ways that share a node, which are the result's own rows: a node has as many as its ways have pairs.

    A way gets the ways behind it at each of its nodes as one list, so that lists are dealt out and not pairs.
    """
    c = F.col
    nodes = load(spark, d, "vertices").select("way_id", "node_id").distinct().groupBy("node_id").agg(F.array_sort(F.collect_list("way_id")).alias("ways"))
    behind = nodes.select("node_id", "ways", F.posexplode("ways").alias("i", "way_id")).filter(c("i") < F.size("ways") - 1)
    met = behind.select("way_id", "node_id", F.slice("ways", c("i") + 2, F.size("ways")).alias("others")).repartition("way_id")
    return met.select("way_id", "node_id", F.explode("others").alias("other_id")).groupBy("way_id", "other_id").agg(F.count(F.lit(1)).alias("shared_nodes"), F.min("node_id").alias("first_node"))


@query("route_for_site", "SELECT o_custkey AS site_id, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS route_id, round(max(o_totalprice) / 10, 4) AS length_m, count(*) AS routes FROM orders GROUP BY o_custkey")
def route_for_site(spark: SparkSession, d: str) -> DataFrame:
    """The longest route that has a member, the lowest id on a tie."""
    routes = load(spark, d, "routes").select(F.col("member_site").alias("site_id"), "route_id", "length_m")
    return routes.groupBy("site_id").agg(F.max_by("route_id", F.struct("length_m", -F.col("route_id"))).alias("route_id"), F.round(F.max("length_m"), 4).alias("length_m"), F.count(F.lit(1)).alias("routes"))


@query("member_coverage", sql("SELECT site_type, count(*) AS sites, count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.site_id)) AS covered, round(sum(CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.site_id) THEN coalesce(elevation_m, 0) ELSE 0 END), 2) AS covered_m FROM sites s GROUP BY site_type", "sites"))
def member_coverage(spark: SparkSession, d: str) -> DataFrame:
    members = load(spark, d, "routes").select(F.col("member_site").alias("site_id")).distinct().withColumn("member", F.lit(True))
    joined = load(spark, d, "sites").join(members, "site_id", "left")
    return joined.groupBy("site_type").agg(F.count(F.lit(1)).alias("sites"), F.count("member").alias("covered"), F.round(F.sum(F.when(F.col("member"), F.coalesce("elevation_m", F.lit(0.0))).otherwise(0.0)), 2).alias("covered_m"))
