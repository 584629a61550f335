"""Queries that take source records in, keep stored results fresh, and give layers out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.operators import spatial
from cairnpath.plans.registry import query
from cairnpath.plans.spatial import DIST, NEAR_SEG, SEGMENTS
from cairnpath.sources.fixtures import load, sql


@query("first_wins_dedupe", "SELECT o_custkey AS source_id, arg_min(o_orderkey, struct_pack(a := o_orderpriority, b := o_orderkey)) AS record, count(*) AS seen FROM orders GROUP BY o_custkey")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of records that several tiles deliver, the first tile's; one aggregate, so a repeated id meets in no window."""
    first = F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey"))
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(first.alias("record"), F.count(F.lit(1)).alias("seen"))


@query("upsert", "WITH old AS (SELECT c_custkey AS id, c_name AS name, 1 AS run_id FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, upper(c_name) AS name, 2 AS run_id FROM customer WHERE c_custkey % 2 = 0) SELECT id, coalesce(new.name, old.name) AS name, coalesce(old.run_id, new.run_id) AS created_run, coalesce(new.run_id, old.run_id) AS updated_run FROM old FULL JOIN new USING (id)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """New records over stored ones by key; what a record was created by stays."""
    customer = load(spark, d, "customer")
    old = customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("old_name"), F.lit(1).alias("old_run"))
    new = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("new_name"), F.lit(2).alias("new_run"))
    return old.join(new, "id", "full").select("id", F.coalesce("new_name", "old_name").alias("name"), F.coalesce("old_run", "new_run").alias("created_run"), F.coalesce("new_run", "old_run").alias("updated_run"))


STATUS = "CASE WHEN p_partkey % 11 = 0 THEN 'missing_id' WHEN p_size % 7 = 0 THEN 'missing_geometry' WHEN p_retailprice < 950 THEN 'invalid' WHEN p_partkey <> first_id THEN 'duplicate' ELSE 'accepted' END"


@query("load_status", f"SELECT p_brand AS source, {STATUS} AS status, count(*) AS n FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS first_id FROM part) GROUP BY ALL")
def load_status(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("first_id"))
    c = F.col
    status = F.when(c("p_partkey") % 11 == 0, "missing_id").when(c("p_size") % 7 == 0, "missing_geometry").when(c("p_retailprice") < 950, "invalid").when(c("p_partkey") != c("first_id"), "duplicate").otherwise("accepted")
    return part.join(first, "p_name").groupBy(c("p_brand").alias("source"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_AREA = "SELECT n_nationkey AS area, -76e0 + n_nationkey AS w, -74.7e0 + n_nationkey + n_nationkey * 0.1e0 AS e, 30e0 + n_nationkey * 0.2e0 AS s, 30.9e0 + n_nationkey * 0.25e0 AS n FROM nation"


@query("area_tiles", f"WITH a AS ({_AREA}), t AS (SELECT *, CAST(ceil(round((e - w) / 0.5e0, 9)) AS BIGINT) AS nx, CAST(ceil(round((n - s) / 0.5e0, 9)) AS BIGINT) AS ny FROM a) SELECT area, i, j, format('{{}}/tile-{{}}-{{}}', area, i, j) AS tile_id, round(w + i * (e - w) / nx, 6) AS west, round(CASE WHEN i = nx - 1 THEN e ELSE w + (i + 1) * (e - w) / nx END, 6) AS east, round(s + j * (n - s) / ny, 6) AS south, round(CASE WHEN j = ny - 1 THEN n ELSE s + (j + 1) * (n - s) / ny END, 6) AS north FROM t, LATERAL (SELECT unnest(range(nx)) AS i), LATERAL (SELECT unnest(range(ny)) AS j)")
def area_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Areas cut in tiles no wider or higher than half a degree, the last column and row ending where the area does."""
    k, c = F.col("n_nationkey"), F.col
    areas = load(spark, d, "nation").select(k.alias("area"), (k - 76.0).alias("w"), (F.lit(-74.7) + k + k * 0.1).alias("e"), (30.0 + k * 0.2).alias("s"), (30.9 + k * 0.25).alias("n"))
    steps = lambda lo, hi: F.ceil(F.round((c(hi) - c(lo)) / 0.5, 9))
    tiles = areas.withColumn("nx", steps("w", "e")).withColumn("ny", steps("s", "n")).withColumn("i", F.explode(F.expr("sequence(0L, nx - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, ny - 1)")))

    def edges(lo: str, hi: str, at: str, of: str) -> tuple:
        place = lambda m: c(lo) + m * (c(hi) - c(lo)) / c(of)
        return F.round(place(c(at)), 6), F.round(F.when(c(at) == c(of) - 1, c(hi)).otherwise(place(c(at) + 1)), 6)

    (west, east), (south, north) = edges("w", "e", "i", "nx"), edges("s", "n", "j", "ny")
    return tiles.select("area", "i", "j", F.format_string("%d/tile-%d-%d", "area", "i", "j").alias("tile_id"), west.alias("west"), east.alias("east"), south.alias("south"), north.alias("north"))


@query("flow_codes", "SELECT p_partkey AS id, code, CASE code WHEN 46006 THEN TRUE WHEN 46007 THEN FALSE WHEN 46003 THEN FALSE END AS perennial, 'stream' AS feature_type FROM (SELECT p_partkey, 46000 + [0, 3, 6, 7][p_size % 4 + 1] AS code FROM part)")
def flow_codes(spark: SparkSession, d: str) -> DataFrame:
    """A broadcast code table; a code that it lacks stops the load."""
    codes = spark.createDataFrame([(46000, None), (46003, False), (46006, True), (46007, False)], "code int, perennial boolean").withColumn("feature_type", F.lit("stream"))  # four rows
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), (46000 + F.element_at(F.array(*(F.lit(x) for x in (0, 3, 6, 7))), F.col("p_size") % 4 + 1)).alias("code"))
    known = F.coalesce(F.col("feature_type"), F.raise_error(F.format_string("unknown flow code %d", "code")).cast("string"))
    return part.join(F.broadcast(codes), "code", "left").select("id", "code", "perennial", known.alias("feature_type"))


@query("waterbody_codes", "SELECT p_partkey AS id, ftype, fcode, CASE ftype WHEN 390 THEN 'lake' WHEN 436 THEN 'lake' WHEN 466 THEN 'wetland' ELSE 'other' END AS feature_type, CASE fcode WHEN 39004 THEN TRUE WHEN 39001 THEN FALSE WHEN 46602 THEN TRUE WHEN 46601 THEN FALSE END AS perennial FROM (SELECT p_partkey, [390, 436, 466, 361, 378][p_size % 5 + 1] AS ftype, [39004, 39001, 46602, 46601, 43600, 39010][p_partkey % 6 + 1] AS fcode FROM part)")
def waterbody_codes(spark: SparkSession, d: str) -> DataFrame:
    """Waterbodies: an unknown type stops the load, an unknown code says nothing of whether there is water all year."""
    kinds = spark.createDataFrame([(390, "lake"), (436, "lake"), (466, "wetland"), (361, "other"), (378, "other")], "ftype int, feature_type string")  # five rows
    codes = spark.createDataFrame([(39004, True), (39001, False), (46602, True), (46601, False)], "fcode int, perennial boolean")  # four rows
    at = lambda values, n: F.element_at(F.array(*(F.lit(x) for x in values)), (n + 1).cast("int"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), at((390, 436, 466, 361, 378), F.col("p_size") % 5).alias("ftype"), at((39004, 39001, 46602, 46601, 43600, 39010), F.col("p_partkey") % 6).alias("fcode"))
    known = F.coalesce(F.col("feature_type"), F.raise_error(F.format_string("unknown waterbody type %d", "ftype")).cast("string"))
    return part.join(F.broadcast(kinds), "ftype", "left").join(F.broadcast(codes), "fcode", "left").select("id", "ftype", "fcode", known.alias("feature_type"), "perennial")


@query("synthetic_ids", "SELECT n_nationkey AS id, sha256(concat_ws('|', n_name, 'designation', CAST(n_regionkey AS VARCHAR), format('{:.4f}', n_nationkey / 3e0))) AS source_id FROM nation")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.sha2(F.concat_ws("|", "n_name", F.lit("designation"), F.col("n_regionkey").cast("string"), F.format_string("%.4f", F.col("n_nationkey") / 3.0)), 256).alias("source_id"))


#: Tag values of ways that may be walked between trails, or not.
ROADS = ("secondary", "tertiary", "unclassified", "residential", "living_street", "service")
PAVED, CLOSED, DRIVES = ("sidewalk", "crossing"), ("private", "no"), ("parking_aisle", "drive-through")
#: Example tags of ways, as expressions over part.
WAY_TAGS = {
    "highway": "CASE p_size % 8 WHEN 0 THEN 'footway' WHEN 1 THEN 'service' WHEN 2 THEN 'residential' WHEN 3 THEN 'path' WHEN 4 THEN 'footway' WHEN 5 THEN 'motorway' WHEN 6 THEN ' tertiary ' ELSE 'track' END",
    "footway": "CASE p_partkey % 6 WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'crossing' WHEN 2 THEN 'link' WHEN 3 THEN 'access_aisle' END",
    "access": "CASE p_partkey % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'no' WHEN 2 THEN 'permissive' END",
    "foot": "CASE p_partkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END",
    "service": "CASE p_partkey % 5 WHEN 0 THEN 'parking_aisle' WHEN 1 THEN 'driveway' END",
    "golf": "CASE WHEN p_partkey % 13 = 0 THEN 'hole' END",
}
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "hiking_ways",
    f"""SELECT id, coalesce(footway NOT IN ('sidewalk', 'crossing', 'traffic_island', 'access_aisle'), TRUE) AND golf IS NULL AS hiking,
        CASE WHEN hw = 'footway' THEN coalesce(footway IN {_IN(PAVED)}, FALSE) ELSE hw IN {_IN(ROADS)} END AND coalesce(access NOT IN {_IN(CLOSED)}, TRUE) AND coalesce(foot <> 'no', TRUE) AND NOT (hw = 'service' AND coalesce(service IN {_IN(DRIVES)}, FALSE)) AS connector
        FROM (SELECT p_partkey AS id, trim({WAY_TAGS['highway']}) AS hw, """ + ", ".join(f"{e} AS {k}" for k, e in WAY_TAGS.items() if k != "highway") + " FROM part)",
)
def hiking_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways of which the tags say that they are trails, or roads and pavements that join trails."""
    tags = F.map_filter(F.create_map(*(x for k, e in WAY_TAGS.items() for x in (F.lit(k), F.expr(e)))), lambda _, v: v.isNotNull())
    tagged = load(spark, d, "part").withColumn("tags", tags)
    at = lambda k: F.trim(F.coalesce(F.col("tags")[k], F.lit("")))
    hiking = ~at("footway").isin("sidewalk", "crossing", "traffic_island", "access_aisle") & ~F.map_contains_key("tags", F.lit("golf"))
    way = F.when(at("highway") == "footway", at("footway").isin(*PAVED)).otherwise(at("highway").isin(*ROADS))
    connector = way & ~at("access").isin(*CLOSED) & (at("foot") != "no") & ~((at("highway") == "service") & at("service").isin(*DRIVES))
    return tagged.select(F.col("p_partkey").alias("id"), hiking.alias("hiking"), connector.alias("connector"))


@query("site_types", "SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STEEL' THEN 'lean_to' WHEN p_type LIKE 'ECONOMY%' THEN 'backcountry' WHEN p_size > 30 THEN 'campground' ELSE 'unknown' END AS site_type, CASE WHEN p_brand LIKE '%1' THEN TRUE WHEN p_brand LIKE '%2' THEN FALSE END AS reservable, TRY_CAST(CASE WHEN p_size % 4 = 0 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS INT) AS capacity FROM part")
def site_types(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fits names the type; what the source doesn't say stays null."""
    c = F.col
    kind = F.when(c("p_type").endswith("STEEL"), "lean_to").when(c("p_type").startswith("ECONOMY"), "backcountry").when(c("p_size") > 30, "campground").otherwise("unknown")
    reservable = F.when(c("p_brand").endswith("1"), True).when(c("p_brand").endswith("2"), False)
    capacity = F.when(c("p_size") % 4 == 0, "many").otherwise(c("p_size").cast("string")).try_cast("int")
    return load(spark, d, "part").select(c("p_partkey").alias("id"), kind.alias("site_type"), reservable.alias("reservable"), capacity.alias("capacity"))


@query("route_members", "SELECT o_custkey AS relation, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS members, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey")
def route_members(spark: SparkSession, d: str) -> DataFrame:
    """Members in their order, side branches left out; a relation's members are one row."""
    members = load(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_custkey").alias("relation"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda m: m["o_orderkey"].cast("string"))
    return members.agg(F.array_join(ids, ",").alias("members"), F.count(F.lit(1)).alias("n"))


@query("folded_keys", "SELECT p_partkey AS id, lower(p_brand) AS k, p_size AS v FROM part")
def folded_keys(spark: SparkSession, d: str) -> DataFrame:
    entries = F.map_entries(F.create_map(F.col("p_brand"), F.col("p_size")))
    lowered = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(lowered).alias("k", "v"))


@query("tag_union", "SELECT id, min(why) AS why FROM (SELECT p_partkey AS id, 'size' AS why FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'price' FROM part WHERE p_retailprice > 1500 UNION ALL SELECT p_partkey, 'brand' FROM part WHERE p_brand LIKE '%3%') GROUP BY id")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    found = [part.filter(cond).select(F.col("p_partkey").alias("id"), F.lit(why).alias("why")) for cond, why in (("p_size > 40", "size"), ("p_retailprice > 1500", "price"), ("p_brand LIKE '%3%'", "brand"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("id").agg(F.min("why").alias("why"))


KEY = "sha256(concat_ws('|', 'weather', '1', format('{:.6f} {:.6f}', round(floor(x_m / 500) * 500 + 250, 6), round(floor(y_m / 500) * 500 + 250, 6))))"
CACHE = f"asked AS (SELECT site_id, {KEY} AS key FROM sites), cache AS (SELECT key, min(site_id) AS value FROM asked WHERE site_id % 3 = 0 GROUP BY key)"


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    mid = lambda c: F.round(F.floor(F.col(c) / 500) * 500 + 250, 6).cast("double")
    key = F.sha2(F.concat_ws("|", F.lit("weather"), F.lit("1"), F.format_string("%.6f %.6f", mid("x_m"), mid("y_m"))), 256)
    return load(spark, d, "sites").select("site_id", key.alias("key"))


@query("cache_lookup", sql(f"{CACHE} SELECT site_id, key, value, value IS NOT NULL AS hit FROM asked LEFT JOIN cache USING (key)", "sites"))
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = cache_keys(spark, d)
    stored = asked.filter("site_id % 3 = 0").groupBy("key").agg(F.min("site_id").alias("value"))
    return asked.join(stored, "key", "left").select("site_id", "key", "value", F.col("value").isNotNull().alias("hit"))


@query("cache_misses", sql(f"{CACHE} SELECT DISTINCT key FROM asked WHERE key NOT IN (SELECT key FROM cache)", "sites"))
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """What is left to compute, each key once."""
    asked = cache_keys(spark, d)
    return asked.join(asked.filter("site_id % 3 = 0"), "key", "left_anti").select("key").distinct()


@query("cache_states", "WITH c AS (SELECT o_custkey AS key, max(o_orderdate) AS stored FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey) SELECT c_custkey AS key, CASE WHEN stored IS NULL THEN 'miss' WHEN stored + to_days(CAST(CASE c_custkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 300 ELSE 3000 END AS INT)) > TIMESTAMP '2025-01-01' THEN 'hit' ELSE 'stale' END AS state FROM customer LEFT JOIN c ON key = c_custkey")
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    """What a lookup finds: the newest stored result if it is younger than its kind's lifetime, a stale one, or none."""
    stored = load(spark, d, "orders").filter("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("stored"))
    k = F.col("c_custkey")
    asked = load(spark, d, "customer").select(k.alias("key"), F.when(k % 3 == 0, 30).when(k % 3 == 1, 300).otherwise(3000).alias("days"))
    fresh = F.col("stored") + F.make_dt_interval("days") > F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    return asked.join(stored, "key", "left").select("key", F.when(F.col("stored").isNull(), "miss").when(fresh, "hit").otherwise("stale").alias("state"))


@query("cache_purge", "SELECT event_id, event_type FROM events WHERE ts + CASE event_type WHEN 'view' THEN INTERVAL 1 HOUR WHEN 'click' THEN INTERVAL 5 MINUTE ELSE INTERVAL 30 DAY END > TIMESTAMP '2024-01-20 00:00:00'")
def cache_purge(spark: SparkSession, d: str) -> DataFrame:
    """Stored results that haven't expired, each kind with its own lifetime."""
    ttl = F.when(F.col("event_type") == "view", F.expr("INTERVAL '1' HOUR")).when(F.col("event_type") == "click", F.expr("INTERVAL '5' MINUTE")).otherwise(F.expr("INTERVAL '30' DAY"))
    return load(spark, d, "events").filter(F.col("ts") + ttl > F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("event_id", "event_type")


@query("forecast_days", "SELECT c_custkey AS site_id, i - 1 AS day, [c_custkey % 13, c_custkey % 7, c_custkey % 5][i] AS rain_mm, [c_custkey % 30, c_custkey % 20, c_custkey % 10][i] AS wind_kmh FROM customer, range(1, 4) r(i)")
def forecast_days(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of a payload as a row a day."""
    k = F.col("c_custkey")
    payload = load(spark, d, "customer").select(k.alias("site_id"), F.array(k % 13, k % 7, k % 5).alias("rain_mm"), F.array(k % 30, k % 20, k % 10).alias("wind_kmh"))
    return payload.select("site_id", F.posexplode(F.arrays_zip("rain_mm", "wind_kmh")).alias("day", "x")).select("site_id", F.col("day").cast("long").alias("day"), "x.rain_mm", "x.wind_kmh")


@query("run_counts", "SELECT o_orderstatus AS step, o_orderpriority AS source, count(*) AS records, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("step"), F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("geojson_features", sql("SELECT site_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || format('{:.6f}', x_m / 1e5) || ',' || format('{:.6f}', y_m / 1e5) || ']},\"properties\":{\"site_type\":\"' || site_type || '\"}}' AS feature FROM sites", "sites"))
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """A GeoJSON feature a line; a collection is these lines between two brackets."""
    at = lambda c: F.format_string("%.6f", F.col(c) / 1e5)
    properties = F.to_json(F.struct("site_type"))
    return load(spark, d, "sites").select("site_id", F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), at("x_m"), F.lit(","), at("y_m"), F.lit(']},"properties":'), properties, F.lit("}")).alias("feature"))


GPX = "'<trkpt lat=\"' || format('{:.6f}', y_m / 1e5) || '\" lon=\"' || format('{:.6f}', x_m / 1e5) || '\"/>'"


@query("gpx_tracks", sql(f"SELECT way_id, '<trk><name>' || way_id || '</name><trkseg>' || string_agg({GPX}, '' ORDER BY pos) || '</trkseg></trk>' AS trk, count(*) AS points FROM vertices GROUP BY way_id", "vertices"))
def gpx_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A GPX track of each way; names are escaped, points stand in their order."""
    at = lambda c: F.format_string("%.6f", F.col(c) / 1e5)
    point = F.concat(F.lit('<trkpt lat="'), at("y_m"), F.lit('" lon="'), at("x_m"), F.lit('"/>'))
    name = F.replace(F.replace(F.col("way_id").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))), lambda x: x["p"]), "")
    return load(spark, d, "vertices").groupBy("way_id").agg(points.alias("pts"), F.count(F.lit(1)).alias("points")).select("way_id", F.concat(F.lit("<trk><name>"), name, F.lit("</name><trkseg>"), "pts", F.lit("</trkseg></trk>")).alias("trk"), "points")


@query("tile_points", sql("SELECT tx, ty, px, py, count(*) AS n FROM (SELECT CAST(floor(x_m / 6250) AS BIGINT) AS tx, CAST(floor(y_m / 6250) AS BIGINT) AS ty, CAST(floor((x_m / 6250 - floor(x_m / 6250)) * 4096) AS BIGINT) AS px, CAST(floor((y_m / 6250 - floor(y_m / 6250)) * 4096) AS BIGINT) AS py FROM sites) GROUP BY ALL", "sites"))
def tile_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of each tile on its grid of 4096."""
    t = lambda c: F.floor(F.col(c) / 6250)
    p = lambda c: F.floor((F.col(c) / 6250 - t(c)) * 4096)
    return load(spark, d, "sites").groupBy(t("x_m").alias("tx"), t("y_m").alias("ty"), p("x_m").alias("px"), p("y_m").alias("py")).agg(F.count(F.lit(1)).alias("n"))


#: The share of sites that must have water and a trail within 1 km, or the layers don't fit together.
ENOUGH = 0.75


@query("coherence", sql(f"{SEGMENTS}, {NEAR_SEG}, n AS (SELECT source, round(avg(CASE WHEN EXISTS (SELECT 1 FROM water f WHERE {DIST} <= 1000) THEN 1e0 ELSE 0e0 END), 6) AS water_share, round(avg(CASE WHEN site_id IN (SELECT site_id FROM hits WHERE d <= 1000) THEN 1e0 ELSE 0e0 END), 6) AS trail_share, count(*) FILTER (elevation_m IS NULL) AS unmeasured, CAST(list_slice(list(site_id ORDER BY site_id) FILTER (elevation_m IS NULL), 1, 3) AS VARCHAR) AS examples FROM sites s GROUP BY source) SELECT *, water_share >= 0.75 AND trail_share >= 0.75 AS fits FROM n", "sites", "water", "vertices"))
def coherence(spark: SparkSession, d: str) -> DataFrame:
    """Shares near water and near a trail, whether both are enough, and what lacks a value, with three examples, which three smallest ids give without a list of all."""
    sites = load(spark, d, "sites")
    points, one = sites.select("site_id", "x_m", "y_m"), F.lit(1.0)
    water = spatial.within(points, load(spark, d, "water"), 1000.0).select("site_id").distinct().withColumn("by_water", one)
    trail = spatial.segment_distance(points, spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), "site_id", 1000.0).select("site_id").withColumn("by_trail", one)
    rank = Window.partitionBy("source").orderBy("site_id")
    few = sites.filter("elevation_m IS NULL").withColumn("k", F.row_number().over(rank)).filter("k <= 3").groupBy("source").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("site_id")), ", "), F.lit("]")).alias("examples"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    counts = sites.join(water, "site_id", "left").join(trail, "site_id", "left").groupBy("source").agg(share("by_water").alias("water_share"), share("by_trail").alias("trail_share"), F.count_if(F.col("elevation_m").isNull()).alias("unmeasured"))
    return counts.join(few, "source", "left").select("source", "water_share", "trail_share", "unmeasured", "examples", ((F.col("water_share") >= ENOUGH) & (F.col("trail_share") >= ENOUGH)).alias("fits"))
