"""Queries that filter, search, sort, page and read text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.functions import text
from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import h, load, sql

FILTERS = "CASE WHEN length_m < 5000 THEN FALSE WHEN length_m > 30000 THEN FALSE WHEN gain_m IS NULL THEN NULL WHEN gain_m > 800 THEN FALSE WHEN kind NOT IN ('F', 'O') THEN FALSE ELSE TRUE END"


def passes() -> F.Column:
    """Whether a route answers all filters; null if it can't be told. Length comes first, since it is always known."""
    c = F.col
    return F.when(c("length_m") < 5000, False).when(c("length_m") > 30000, False).when(c("gain_m").isNull(), F.lit(None).cast("boolean")).when(c("gain_m") > 800, False).when(~c("kind").isin("F", "O"), False).otherwise(True)


@query("route_filter", sql(f"SELECT route_id, length_m, gain_m FROM routes WHERE {FILTERS}", "routes"))
def route_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "routes").filter(passes()).select("route_id", "length_m", "gain_m")


@query("route_filter_counts", sql(f"SELECT kind, count(*) FILTER ({FILTERS}) AS passed, count(*) FILTER (({FILTERS}) IS NULL) AS unknown, count(*) FILTER (NOT ({FILTERS})) AS failed FROM routes GROUP BY kind", "routes"))
def route_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    p = passes()
    return load(spark, d, "routes").groupBy("kind").agg(F.count_if(p).alias("passed"), F.count_if(p.isNull()).alias("unknown"), F.count_if(~p).alias("failed"))


BOX = "x_m >= 20000 AND x_m <= 60000 AND y_m >= 10000 AND y_m <= 70000"


@query("viewport_sites", sql(f"SELECT site_id, round(x_m, 3) AS x_m, round(y_m, 3) AS y_m, site_type FROM sites WHERE {BOX} AND source = 'osm'", "sites"))
def viewport_sites(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sites").filter(f"{BOX} AND source = 'osm'").select("site_id", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"), "site_type")


@query("sampled_sites", sql(f"SELECT site_id FROM sites WHERE {BOX} ORDER BY {h('site_id')}, site_id LIMIT 200", "sites"))
def sampled_sites(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of a viewport: the first 200 by hash, a top-k of each task merged in one."""
    return load(spark, d, "sites").filter(BOX).orderBy(F.expr(h("site_id")), "site_id").limit(200).select("site_id")


@query("viewport_truncation", sql(f"n AS (SELECT count(*) AS n FROM sites WHERE {BOX}) SELECT least(n, 200) AS returned, n > 200 AS truncated, CASE WHEN n > 200 THEN n END AS total FROM n", "sites"))
def viewport_truncation(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "sites").filter(BOX).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(200)).alias("returned"), (F.col("n") > 200).alias("truncated"), F.when(F.col("n") > 200, F.col("n")).alias("total"))


@query("row_caps", "SELECT r_regionkey AS box, CASE WHEN a <= 0.01 THEN 6000 WHEN a <= 0.1 THEN 4000 WHEN a <= 1 THEN 2500 WHEN a <= 5 THEN 1500 ELSE 1000 END AS cap, greatest(-180e0, w - 0.5e0 * s) AS grown_w, least(180e0, w + 1.5e0 * s) AS grown_e FROM (SELECT r_regionkey, pow(10e0, r_regionkey - 2) * 0.09e0 AS a, pow(10e0, r_regionkey - 2) AS s, -179.9e0 + r_regionkey AS w FROM region)")
def row_caps(spark: SparkSession, d: str) -> DataFrame:
    """The row cap of a box by its area, and the box grown by half its width on each side."""
    s = F.pow(F.lit(10.0), F.col("r_regionkey") - 2)
    a, w = s * 0.09, F.lit(-179.9) + F.col("r_regionkey")
    cap = F.when(a <= 0.01, 6000).when(a <= 0.1, 4000).when(a <= 1, 2500).when(a <= 5, 1500).otherwise(1000)
    return load(spark, d, "region").select(F.col("r_regionkey").alias("box"), cap.alias("cap"), F.greatest(F.lit(-180.0), w - 0.5 * s).alias("grown_w"), F.least(F.lit(180.0), w + 1.5 * s).alias("grown_e"))


@query("routes_by_gain", sql("SELECT route_id, gain_m, length_m FROM routes ORDER BY gain_m DESC NULLS LAST, length_m DESC, route_id LIMIT 50 OFFSET 100", "routes"))
def routes_by_gain(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty."""
    return load(spark, d, "routes").orderBy(F.desc_nulls_last("gain_m"), F.desc("length_m"), "route_id").offset(100).limit(50).select("route_id", "gain_m", "length_m")


@query("route_pages", sql("p AS (SELECT route_id, routes.name, length_m, sqrt(pow(x_m - 50000, 2) + pow(y_m - 50000, 2)) AS d FROM routes JOIN sites ON site_id = member_site WHERE kind = 'F'), a AS (SELECT 'distance' AS key, route_id, row_number() OVER (ORDER BY round(d, 3), route_id) AS place FROM p UNION ALL SELECT 'name', route_id, row_number() OVER (ORDER BY name, length_m DESC, route_id) FROM p) SELECT key, place, route_id, (SELECT count(*) FROM p) AS total FROM a WHERE place <= 20", "routes", "sites"))
def route_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty routes by distance from a point and by name, with how many there are in all; each order is a top-k."""
    c = F.col
    away = F.round(F.sqrt(F.pow(c("x_m") - 50000, 2) + F.pow(c("y_m") - 50000, 2)), 3)
    found = load(spark, d, "routes").filter("kind = 'F'").join(load(spark, d, "sites").select(c("site_id").alias("member_site"), "x_m", "y_m"), "member_site").select("route_id", "name", "length_m", away.alias("d"))
    total = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    pages = []
    for key, order in (("distance", ["d", "route_id"]), ("name", ["name", F.desc("length_m"), "route_id"])):
        first = found.orderBy(*order).limit(20)
        pages.append(first.select(F.lit(key).alias("key"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "route_id"))  # of twenty rows
    return pages[0].unionByName(pages[1]).crossJoin(F.broadcast(total))


@query("longest_routes", sql("SELECT route_id, length_m FROM routes ORDER BY length_m DESC, route_id LIMIT 101", "routes"))
def longest_routes(spark: SparkSession, d: str) -> DataFrame:
    """One more than a page, which tells whether there is another."""
    return load(spark, d, "routes").orderBy(F.desc("length_m"), "route_id").limit(101).select("route_id", "length_m")


@query("alerts_by_severity", "SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(list_position(['purchase', 'click', 'view'], event_type), 99), ts, event_id) AS rank FROM events QUALIFY rank <= 3")
def alerts_by_severity(spark: SparkSession, d: str) -> DataFrame:
    """Each user's three gravest events; types that aren't listed come last."""
    listed = F.array(*(F.lit(x) for x in ("purchase", "click", "view")))
    grave = F.when(F.array_contains(listed, F.col("event_type")), F.array_position(listed, F.col("event_type"))).otherwise(99)
    w = Window.partitionBy("user_id").orderBy(grave, "ts", "event_id")
    return load(spark, d, "events").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


NAMES = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE p_partkey % 3 WHEN 0 THEN ' Été' WHEN 1 THEN ' Pond' ELSE ' Ñandú' END)"


@query("name_search", f"SELECT p_partkey AS id, {NAMES} AS name, trim(regexp_replace(lower({NAMES}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part WHERE strip_accents(lower({NAMES})) LIKE '%e%' AND strip_accents(lower({NAMES})) LIKE '%ete%'")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Names that have all words of a search, whatever their case and accents."""
    name = F.concat(F.initcap(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"), F.when(F.col("p_partkey") % 3 == 0, " Été").when(F.col("p_partkey") % 3 == 1, " Pond").otherwise(" Ñandú"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).filter(text.has_all_words(F.col("name"), ["e", "ete"])).withColumn("slug", text.slug(F.col("name")))


ELE = "CASE p_partkey % 8 WHEN 0 THEN CAST(p_size * 37 AS VARCHAR) || ' m' WHEN 1 THEN CAST(p_size * 90 AS VARCHAR) || ' ft' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN 'about ' || CAST(p_size AS VARCHAR) WHEN 4 THEN '9' || CAST(p_size + 100000 AS VARCHAR) WHEN 5 THEN '1,' || CAST(p_size + 100 AS VARCHAR) || ' m' WHEN 6 THEN CAST(p_size AS VARCHAR) || '.25 Metres' ELSE NULL END"


@query("elevation_texts", "SELECT p_partkey AS id, round(CASE p_partkey % 8 WHEN 0 THEN p_size * 37e0 WHEN 1 THEN p_size * 90 * 0.3048e0 WHEN 2 THEN p_size * 1e0 WHEN 6 THEN p_size + 0.25e0 END, 1) AS elevation_m FROM part")
def elevation_texts(spark: SparkSession, d: str) -> DataFrame:
    free = F.expr(ELE.replace("VARCHAR", "STRING"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.elevation_m(free).alias("elevation_m"))


#: A request put together from a row: lengths, climb, nights, and words for the rest.
ASKED = """
    ['Easy', 'A demanding', 'moderate', 'Some'][p_partkey % 4 + 1] || ' ' || ['loop', 'out-and-back', 'end-to-end', 'walk'][p_partkey % 4 + 1] || ', '
    || CASE p_partkey % 4 WHEN 0 THEN 'no more than ' || p_size || ' miles' WHEN 1 THEN p_size || '-' || (p_size + 3) || ' mi' WHEN 2 THEN 'between ' || p_size || ' and ' || (p_size + 5) || ' miles' ELSE p_size || '-mile' END
    || CASE p_partkey % 5 WHEN 0 THEN ', at least 2,500 feet of climbing' WHEN 1 THEN ' with 900 ft max' WHEN 2 THEN ', flat' ELSE '' END
    || CASE p_partkey % 6 WHEN 0 THEN ', two nights' WHEN 1 THEN ' on a weekend' WHEN 2 THEN ', 4 days' WHEN 3 THEN ' day hike' WHEN 4 THEN '; a couple of nights' ELSE '' END
    || CASE p_partkey % 7 WHEN 0 THEN ' near a pond' WHEN 1 THEN ' in Vermont' WHEN 2 THEN ' in the ADK or Maine' WHEN 3 THEN ' with a lean-to' WHEN 4 THEN ', quiet, kids' WHEN 5 THEN ', out of the wind' ELSE '' END"""
ASKED_SQL = """
    SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 3 THEN round(p_size * 0.8e0, 1) ELSE CAST(p_size AS DOUBLE) END AS min_mi,
           CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 3e0 WHEN 2 THEN p_size + 5e0 ELSE round(p_size * 1.2e0, 1) END AS max_mi,
           CASE WHEN p_partkey % 5 = 0 THEN 2500e0 END AS min_climb_ft, CASE p_partkey % 5 WHEN 1 THEN 900e0 WHEN 2 THEN 500e0 END AS max_climb_ft,
           CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 2 END AS nights,
           ['easy', 'hard', 'moderate', NULL][p_partkey % 4 + 1] AS difficulty, ['loop', 'out_and_back', 'point_to_point', NULL][p_partkey % 4 + 1] AS route_type,
           CASE WHEN p_partkey % 7 = 1 THEN 'green-mountains-vt' END AS region, CASE WHEN p_partkey % 7 = 3 THEN TRUE END AS has_campsites, CASE WHEN p_partkey % 7 = 0 THEN TRUE END AS water_view,
           CASE WHEN p_partkey % 7 = 5 THEN TRUE END AS sheltered, CASE WHEN p_partkey % 7 = 4 THEN 'crowding,kid-friendliness' END AS unsupported
    FROM part"""


@query("request_parse", ASKED_SQL)
def request_parse(spark: SparkSession, d: str) -> DataFrame:
    """Requests in words as filters; a region only if one alone is named."""
    phrase = F.expr(ASKED.replace("[p_partkey % 4 + 1]", ", cast(p_partkey % 4 + 1 as int))").replace("['", "element_at(array('").replace("'], cast", "'), cast"))
    # Rows are small and their words take long, so they are dealt out over the cores whatever the file's size.
    part = load(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return text.requests(part.select(F.col("p_partkey").alias("id"), phrase.alias("phrase")), F.col("phrase")).drop("phrase")


@query("route_ids", "SELECT o_orderkey AS id, format('{:.6f},{:.6f}', o_orderkey / 1000e0, o_custkey / 7e0) AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS way FROM orders")
def route_ids(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "node/").otherwise("way/"), F.col("o_orderkey"))
    way = F.nullif(F.regexp_extract(source, r"^way/(\d+)$", 1), F.lit("")).try_cast("long")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("%.6f,%.6f", F.col("o_orderkey") / 1000.0, F.col("o_custkey") / 7.0).alias("candidate_id"), way.alias("way"))


@query("durations", sql("SELECT route_id, CASE WHEN m < 60 THEN format('{} min', m) WHEN m % 60 = 0 THEN format('{} h', m // 60) ELSE format('{} h {:02d} min', m // 60, m % 60) END AS duration FROM (SELECT route_id, greatest(1, CAST(round_even(length_m / 80, 0) AS BIGINT)) AS m FROM routes)", "routes"))
def durations(spark: SparkSession, d: str) -> DataFrame:
    """Whole minutes, one at least, as text."""
    m = F.greatest(F.lit(1).cast("long"), F.bround(F.col("length_m") / 80, 0).cast("long"))
    hours = F.floor(m / 60).cast("long")
    return load(spark, d, "routes").select("route_id", F.when(m < 60, F.format_string("%d min", m)).when(m % 60 == 0, F.format_string("%d h", hours)).otherwise(F.format_string("%d h %02d min", hours, m % 60)).alias("duration"))


@query("event_tags", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, strftime(date_trunc('hour', min(ts)), '%Y-%m-%dT%H:%M:%SZ') AS first_hour FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def event_tags(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a JSON key, rows without it left out, with the first hour as ISO text."""
    tagged = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long") % 10).filter("k IS NOT NULL")
    return tagged.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.date_trunc("hour", F.min("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_hour"))


@query("route_comparison", sql("SELECT route_id, label, value FROM (SELECT route_id, 'Length' AS label, CAST(round(length_m / 1000, 1) AS VARCHAR) || ' km' AS value FROM routes UNION ALL SELECT route_id, 'Climb', CASE WHEN gain_m IS NULL THEN 'not measured' ELSE CAST(CAST(round(gain_m) AS BIGINT) AS VARCHAR) || ' m' END FROM routes UNION ALL SELECT route_id, 'Descent', CASE WHEN gain_m IS NULL THEN 'not measured' ELSE CAST(CAST(round(loss_m) AS BIGINT) AS VARCHAR) || ' m' END FROM routes UNION ALL SELECT route_id, 'Per km', CASE WHEN gain_m IS NULL THEN 'not measured' ELSE CAST(CAST(round(gain_m / (length_m / 1000)) AS BIGINT) AS VARCHAR) || ' m' END FROM routes)", "routes"))
def route_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A route as rows of a comparison; what isn't known says so."""
    metres = lambda v: F.when(F.col("gain_m").isNull(), "not measured").otherwise(F.concat(F.round(v).cast("long").cast("string"), F.lit(" m")))
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    rows = F.array(row("Length", F.concat(F.round(F.col("length_m") / 1000, 1).cast("string"), F.lit(" km"))), row("Climb", metres(F.col("gain_m"))), row("Descent", metres(F.col("loss_m"))), row("Per km", metres(F.col("gain_m") / (F.col("length_m") / 1000))))
    return load(spark, d, "routes").select("route_id", F.inline(rows))
