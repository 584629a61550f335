"""Queries that score, rate and classify sites and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnpath.functions import curves
from cairnpath.operators import spatial
from cairnpath.plans.registry import query
from cairnpath.plans.spatial import DIST, INSIDE, NEAR_TRAIL, RANKED, SEGMENTS, STRICT, land_by_site, parcels, water_factor
from cairnpath.sources.fixtures import h, load, sql

WEATHER = "100 - least(40e0, coalesce(rain_mm, 0) * 4) - least(30e0, greatest(0e0, coalesce(wind_kmh, 0) - 25)) - CASE WHEN low_c IS NULL THEN 0 ELSE least(30e0, greatest(0e0, -low_c) * 3) END"


def piecewise_sql(x: str, points: list[tuple[float, float]]) -> str:
    steps = " ".join(f"WHEN {x} <= {b[0]} THEN {a[1]} + ({b[1]} - {a[1]}) * ({x} - {a[0]}) / ({b[0]} - {a[0]})" for a, b in zip(points, points[1:], strict=False))
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {points[0][0]} THEN {points[0][1]} {steps} ELSE {points[-1][1]} END"


SLOPE_SQL, VIEW_SQL = piecewise_sql("slope_deg", curves.SLOPE), piecewise_sql("view_km2", curves.VIEW)
#: Pooling of low ground: water drains in, or a hollow that it drains into; a hollow alone is at most medium.
POOLING_SQL = "CASE WHEN twi >= 12.5 THEN 'high' WHEN sink_m >= 0.3 AND twi >= 10 THEN 'high' WHEN sink_m >= 0.1 OR twi >= 10 THEN 'medium' ELSE 'low' END"
SHELTER_SQL = "CASE WHEN dev >= 1 THEN 'exposed' WHEN dev < -0.75 THEN 'sheltered' ELSE 'moderate' END"


def pooling() -> Column:
    twi, sink = F.col("twi"), F.col("sink_m")
    return F.when((twi >= 12.5) | (sink >= 0.3) & (twi >= 10), "high").when((sink >= 0.1) | (twi >= 10), "medium").otherwise("low")


def shelter() -> Column:
    return F.when(F.col("dev") >= 1, "exposed").when(F.col("dev") < -0.75, "sheltered").otherwise("moderate")


def wind_class() -> Column:
    """How far upwind the ground first rises; negative: not within so many metres, which says nothing if they are under 1 km."""
    fetch = F.col("fetch_m")
    return F.when(fetch.between(-999.999999, -0.000001), F.lit(None).cast("string")).when((fetch < 0) | (fetch >= 1000), "exposed").when(fetch < 300, "sheltered").otherwise("moderate")


WIND_SQL = "CASE WHEN fetch_m < 0 THEN CASE WHEN -fetch_m < 1000 THEN NULL ELSE 'exposed' END WHEN fetch_m < 300 THEN 'sheltered' WHEN fetch_m < 1000 THEN 'moderate' ELSE 'exposed' END"
SUN = {"N": "little direct sun", "NE": "early morning sun", "E": "morning sun", "SE": "morning and midday sun", "S": "sun most of the day", "SW": "afternoon sun", "W": "afternoon and evening sun", "NW": "evening sun"}


@query("weather_factor", sql(f"SELECT site_id, round({WEATHER}, 4) AS score FROM weather", "weather"))
def weather_factor(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "weather").select("site_id", F.round(curves.weather_score(F.col("rain_mm"), F.col("wind_kmh"), F.col("low_c")), 4).alias("score"))


@query("slope_factor", sql(f"SELECT site_id, round({SLOPE_SQL}, 4) AS score FROM terrain", "terrain"))
def slope_factor(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "terrain").select("site_id", F.round(curves.piecewise(F.col("slope_deg"), curves.SLOPE), 4).alias("score"))


@query("terrain_factors", sql(f"SELECT site_id, {POOLING_SQL} AS pooling, CASE {POOLING_SQL} WHEN 'low' THEN 100e0 WHEN 'medium' THEN 60e0 ELSE 10e0 END AS drainage, CASE {SHELTER_SQL} WHEN 'sheltered' THEN 100e0 WHEN 'moderate' THEN 75e0 ELSE 35e0 END AS shelter, CASE WHEN view_km2 IS NULL THEN NULL ELSE round(least(100, {VIEW_SQL} + CASE WHEN water_view THEN 20 ELSE 0 END), 4) END AS view FROM terrain", "terrain"))
def terrain_factors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "terrain").select("site_id", pooling().alias("pooling"), curves.lookup(pooling(), {"low": 100.0, "medium": 60.0, "high": 10.0}, 0.0).alias("drainage"), curves.lookup(shelter(), {"sheltered": 100.0, "moderate": 75.0, "exposed": 35.0}, 0.0).alias("shelter"), F.round(view_score(), 4).alias("view"))


def view_score() -> Column:
    base = curves.piecewise(F.col("view_km2"), curves.VIEW) + F.when(F.col("water_view"), 20).otherwise(0)
    return F.when(base.isNotNull(), F.least(F.lit(100.0), base))  # least() would pass over a null


@query("terrain_classes", sql(f"""c AS (SELECT *, CASE WHEN slope_deg < 4 THEN 'flat' ELSE ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor((aspect_deg % 360 + 22.5) / 45) AS INT) % 8 + 1] END AS facing FROM terrain)
    SELECT site_id, facing, CASE facing {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SUN.items())} ELSE 'sun all day where trees allow' END AS sun,
    CASE WHEN percentile < 10 THEN 'high' WHEN percentile < 25 THEN 'medium' ELSE 'low' END AS cold_air, {WIND_SQL} AS wind,
    CASE WHEN slope_deg < 27 THEN 'none' WHEN slope_deg < 30 THEN '27' WHEN slope_deg < 35 THEN '30' WHEN slope_deg < 45 THEN '35' ELSE '45' END AS slope_band FROM c""", "terrain"))
def terrain_classes(spark: SparkSession, d: str) -> DataFrame:
    facing = F.when(F.col("slope_deg") < 4, "flat").otherwise(curves.sector(F.col("aspect_deg")))
    sun = F.create_map(*(F.lit(x) for kv in SUN.items() for x in kv))
    bands = curves.bands(F.col("slope_deg"), [(27, "none"), (30, "27"), (35, "30"), (45, "35")], "45")
    return load(spark, d, "terrain").withColumn("facing", facing).select("site_id", "facing", F.coalesce(sun[F.col("facing")], F.lit("sun all day where trees allow")).alias("sun"), curves.bands(F.col("percentile"), [(10, "high"), (25, "medium")], "low").alias("cold_air"), wind_class().alias("wind"), bands.alias("slope_band"))


LAND = f"""lands AS (SELECT site_id, arg_min(access, struct_pack(a := {STRICT}, b := coalesce(gap, '9'), c := land_id)) AS access, arg_min(coalesce(gap, ''), struct_pack(a := {STRICT}, b := coalesce(gap, '9'), c := land_id)) AS gap, string_agg(l.name, '; ' ORDER BY l.name) AS land_names FROM sites s JOIN land l ON {INSIDE} GROUP BY site_id),
    legal AS (SELECT site_id, CASE WHEN access IS NULL THEN 15e0 ELSE CASE access WHEN 'open' THEN 100e0 WHEN 'restricted' THEN 45e0 WHEN 'unknown' THEN 40e0 ELSE 0e0 END * CASE gap WHEN '1' THEN 1e0 WHEN '2' THEN 1e0 WHEN '3' THEN 0.9e0 WHEN '4' THEN 0.75e0 ELSE 0.85e0 END END AS legal, access, land_names,
        CASE WHEN access = 'open' THEN 'permitted' WHEN access = 'closed' THEN 'not_permitted' ELSE 'unknown' END AS gate FROM sites LEFT JOIN lands USING (site_id))"""


def legal_factor(sites: DataFrame, inside: DataFrame) -> DataFrame:
    joined = sites.select("site_id").join(land_by_site(inside), "site_id", "left")
    score = curves.lookup(F.col("access"), curves.ACCESS, 40.0) * curves.lookup(F.coalesce("gap", F.lit("")), curves.GAP, 0.85)
    gate = F.when(F.col("access") == "open", "permitted").when(F.col("access") == "closed", "not_permitted").otherwise("unknown")
    return joined.select("site_id", F.when(F.col("access").isNull(), 15.0).otherwise(score).alias("legal"), "access", gate.alias("gate"), "land_names")


@query("legal_gate", sql(LAND + " SELECT site_id, access, round(legal, 4) AS legal, gate FROM legal", "sites", "land"))
def legal_gate(spark: SparkSession, d: str) -> DataFrame:
    return legal_factor(load(spark, d, "sites"), parcels(spark, d)).select("site_id", "access", F.round("legal", 4).alias("legal"), "gate")


TRAIL = "trails AS (SELECT site_id, min(d) AS trail_m FROM hits WHERE d <= 5000 GROUP BY site_id)"
TRAIL_SCORE = "CASE WHEN trail_m IS NULL THEN 0 WHEN trail_m <= 60 THEN 50 + 50 * trail_m / 60 ELSE 100 * pow(0.5e0, (trail_m - 60) / 800) END"


def trail_score() -> Column:
    return F.coalesce(curves.peak_curve(F.col("trail_m"), 60.0, 50.0, 800.0), F.lit(0.0))


def trail_distance(spark: SparkSession, d: str, sites: DataFrame | None = None) -> DataFrame:
    """site_id and trail_m, up to 5 km."""
    points = load(spark, d, "sites") if sites is None else sites
    near = spatial.segment_distance(points.select("site_id", "x_m", "y_m"), spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), "site_id", 5000.0)
    return near.withColumnRenamed("nearest_m", "trail_m")


@query("trail_factor", sql(f"{SEGMENTS}, {NEAR_TRAIL}, {TRAIL} SELECT site_id, round({TRAIL_SCORE}, 4) AS score FROM sites LEFT JOIN trails USING (site_id)", "sites", "vertices"))
def trail_factor(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sites").select("site_id").join(trail_distance(spark, d), "site_id", "left").select("site_id", F.round(trail_score(), 4).alias("score"))


W = curves.WEIGHTS
FACTORS = ("water", "legal", "trail", "weather", "slope", "drainage", "shelter", "view")
_SUM = lambda names, expr: " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {W[n]}e0 * {expr(n)} END" for n in names)
_REST = [n for n in FACTORS if n != "legal"]
FULL = f"""{RANKED}, {LAND}, {SEGMENTS}, {NEAR_TRAIL}, {TRAIL},
    f AS (SELECT site_id, access, gate, coalesce(water_score, 0) AS water, legal, {TRAIL_SCORE} AS trail, CASE WHEN rain_mm IS NULL THEN NULL ELSE {WEATHER} END AS weather, {SLOPE_SQL} AS slope,
        CASE {POOLING_SQL} WHEN 'low' THEN 100e0 WHEN 'medium' THEN 60e0 ELSE 10e0 END AS drainage, CASE {SHELTER_SQL} WHEN 'sheltered' THEN 100e0 WHEN 'moderate' THEN 75e0 ELSE 35e0 END AS shelter, CASE WHEN {VIEW_SQL} IS NULL THEN NULL ELSE least(100, {VIEW_SQL} + CASE WHEN water_view THEN 20 ELSE 0 END) END AS view
        FROM sites LEFT JOIN best USING (site_id) LEFT JOIN legal USING (site_id) LEFT JOIN trails USING (site_id) JOIN weather USING (site_id) JOIN terrain USING (site_id)),
    t AS (SELECT *, ({_SUM(FACTORS, str)}) / ({_SUM(FACTORS, lambda n: '1')}) AS total, ({_SUM(_REST, str)}) / ({_SUM(_REST, lambda n: '1')}) AS rest FROM f)"""


def factor_table(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """All factor scores of each site, or of only those with a row in only (site_id); a factor that can't be evaluated is null."""
    sites = load(spark, d, "sites")
    sites = sites if only is None else sites.join(only.select("site_id"), "site_id", "left_semi")
    trails = trail_distance(spark, d, sites)
    weather = load(spark, d, "weather").select("site_id", F.when(F.col("rain_mm").isNotNull(), curves.weather_score(F.col("rain_mm"), F.col("wind_kmh"), F.col("low_c"))).alias("weather"))
    terrain = load(spark, d, "terrain").select("site_id", curves.piecewise(F.col("slope_deg"), curves.SLOPE).alias("slope"), curves.lookup(pooling(), {"low": 100.0, "medium": 60.0, "high": 10.0}, 0.0).alias("drainage"), curves.lookup(shelter(), {"sheltered": 100.0, "moderate": 75.0, "exposed": 35.0}, 0.0).alias("shelter"), view_score().alias("view"))
    out = sites.select("site_id").join(water_factor(sites, load(spark, d, "water")).select("site_id", F.col("water_score").alias("water")), "site_id")
    out = out.join(legal_factor(sites, parcels(spark, d, sites)), "site_id").join(trails, "site_id", "left").withColumn("trail", trail_score()).drop("trail_m")
    return out.join(weather, "site_id").join(terrain, "site_id")


def weighted(names: tuple[str, ...] | list[str], weights: dict[str, float] = W) -> Column:
    """The weighted mean of the columns that aren't null; null if none is left."""
    top = sum((F.coalesce(F.col(n), F.lit(0.0)) * weights[n] for n in names), F.lit(0.0))
    low = sum((F.when(F.col(n).isNotNull(), weights[n]).otherwise(0.0) for n in names), F.lit(0.0))
    return F.when(low > 0, top / low)


def scored(factors: DataFrame) -> DataFrame:
    """Total with caps, suitability without legality, and the letter, rounded half to even."""
    total = F.when(F.col("access") == "closed", F.least(F.lit(0.0), weighted(FACTORS))).otherwise(weighted(FACTORS))
    # To nine places first, so that the order of a sum doesn't decide a half.
    whole = lambda c: F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 9), 0).cast("int")
    return factors.withColumn("score", whole(total)).withColumn("suitability", whole(weighted(_REST))).withColumn("grade", curves.grade(F.col("suitability")))


_WHOLE = lambda e: f"CAST(round_even(round(greatest(0, least(100, {e})), 9), 0) AS INT)"
GRADE_SQL = "CASE WHEN suitability IS NULL THEN NULL WHEN suitability >= 90 THEN 'A' WHEN suitability >= 80 THEN 'B' WHEN suitability >= 70 THEN 'C' WHEN suitability >= 60 THEN 'D' ELSE 'F' END"
SCORED = f"{FULL}, final AS (SELECT *, {_WHOLE('CASE WHEN access = $$closed$$ THEN least(0, total) ELSE total END')} AS score, {_WHOLE('rest')} AS suitability FROM t)"


@query("site_score", sql(f"{SCORED} SELECT site_id, score, suitability, gate, {GRADE_SQL} AS grade FROM final", "sites", "water", "land", "vertices", "weather", "terrain"))
def site_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(factor_table(spark, d)).select("site_id", "score", "suitability", "gate", "grade")


@query("score_contributions", sql(f"{SCORED} SELECT site_id, " + ", ".join(f"round(CASE WHEN {n} IS NULL THEN 0 ELSE {W[n]}e0 * {n} END / ({_SUM(FACTORS, lambda m: '1')}), 3) AS {n}" for n in FACTORS) + " FROM final", "sites", "water", "land", "vertices", "weather", "terrain"))
def score_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What each factor adds to the uncapped total."""
    low = sum((F.when(F.col(n).isNotNull(), W[n]).otherwise(0.0) for n in FACTORS), F.lit(0.0))
    return factor_table(spark, d).select("site_id", *(F.round(F.coalesce(F.col(n), F.lit(0.0)) * W[n] / low, 3).alias(n) for n in FACTORS))


FEET = 3.280839895013123
#: Metres of a unit; a length that is in a unit already stays exactly as it is.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.344}
#: Example regions in the order in which a point is looked up, edges included: their box, whose operators vouch for a site,
#: and rules of four kinds, each with the names that it holds for (none: everywhere).
REGIONS = [
    {
        "id": "north", "box": (0.0, 60000.0, 100000.0, 100000.0), "operators": ["ridb"],
        "rules": [
            {"id": "all_4000", "kind": "max_elevation", "limit": (4000.0, "ft")},
            {"id": "peaks_3500", "kind": "max_elevation", "limit": (3500.0, "ft"), "where": {"land_name_contains": ["nation_2", "nation_16"]}, "exempt": ["lean_to"]},
        ],
    },
    {
        "id": "south", "box": (20000.0, 10000.0, 100000.0, 65000.0), "operators": [],
        "rules": [
            {"id": "scenic", "kind": "no_camping", "where": {"land_name_in": ["nation_3", "nation_8"]}},
            {"id": "trail_200", "kind": "setback", "from": "trail", "distance": (200.0, "ft"), "where": {"land_name_contains": ["nation_1"]}},
            {"id": "water_200", "kind": "setback", "from": "water", "distance": (200.0, "ft")},
        ],
    },
]
#: Margins of elevation in feet and of distance in metres within which the data can't decide.
MARGIN_FT, MARGIN_M = 50.0, 15.0


def length_in(length: tuple[float, str], unit: str) -> float:
    value, own = length
    return value if own == unit else value * UNITS[own] / UNITS[unit]


def applies(rule: dict) -> Column:
    """Whether a rule holds at a site: any of its names fits, or it has none."""
    land = F.lower(F.coalesce("land_names", F.lit("")))
    found = F.lit(not rule.get("where"))
    for key, names in rule.get("where", {}).items():
        if key == "land_name_contains":
            for n in names:
                found = found | F.contains(land, F.lit(n))
        else:
            column = land if key == "land_name_in" else F.lower(F.coalesce(key.removesuffix("_in"), F.lit("")))
            found = found | column.isin(names)
    return found


def region_at() -> Column:
    inside = lambda b: F.col("x_m").between(b[0], b[2]) & F.col("y_m").between(b[1], b[3])
    return F.coalesce(*(F.when(inside(r["box"]), r["id"]) for r in REGIONS))


def decide(region: dict) -> Column:
    """verdict and reason in one region, the first of the ordered list that fits: closed land, no camping, elevation with its margin, designation, setbacks."""
    c, known, ft = F.col, F.col("basis").isNotNull(), F.col("elevation_ft")
    of = lambda kind: [r for r in region["rules"] if r["kind"] == kind]
    say = lambda verdict, reason: F.struct((verdict if isinstance(verdict, Column) else F.lit(verdict)).alias("verdict"), F.lit(reason).alias("reason"))
    unless_known = F.when(known, "unknown").otherwise("not_permitted")
    out = F.when(c("gate") == "not_permitted", say(unless_known, "closed"))
    for rule in of("no_camping"):
        out = out.when(applies(rule), say(unless_known, rule["id"]))
    limited = F.lit(False)
    for rule in of("max_elevation"):
        here, limit = applies(rule) & ~c("site_type").isin(rule.get("exempt", [])), length_in(rule["limit"], "ft")
        limited = limited | here
        out = out.when(here & (ft > limit + MARGIN_FT) & ~known, say("not_permitted", rule["id"])).when(here & (ft >= limit - MARGIN_FT), say("unknown", rule["id"]))
    out = out.when(known & limited & ft.isNull(), say("unknown", "no_elevation")).when(known, say("permitted", "designated"))
    for rule in of("setback"):
        away, least = c(f"{rule['from']}_m"), length_in(rule["distance"], "m")
        out = out.when(applies(rule) & (away < least - MARGIN_M), say("unknown", rule["id"])).when(applies(rule) & (away < least + MARGIN_M), say("unknown", rule["id"] + "_margin"))
    return out.otherwise(say("unknown", "undesignated"))


WATERS = f"waters AS (SELECT site_id, min({DIST}) AS water_m FROM sites s JOIN water f ON abs(s.x_m - f.x_m) <= 1000 AND abs(s.y_m - f.y_m) <= 1000 WHERE {DIST} <= 1000 GROUP BY site_id)"
VERDICT_SQL = f"""{WATERS}, ft AS (SELECT s.site_id, CASE WHEN x_m BETWEEN 0 AND 100000 AND y_m BETWEEN 60000 AND 100000 THEN 'north' WHEN x_m BETWEEN 20000 AND 100000 AND y_m BETWEEN 10000 AND 65000 THEN 'south' END AS region, site_type, gate, lower(coalesce(land_names, '')) AS land,
        CAST(round_even(elevation_m * {FEET}, 0) AS BIGINT) AS ft, trail_m, water_m, CASE WHEN source = 'ridb' THEN 'listed by Recreation.gov' WHEN site_type = 'lean_to' THEN 'a lean-to' END AS basis FROM sites s JOIN legal USING (site_id) LEFT JOIN trails USING (site_id) LEFT JOIN waters USING (site_id)),
    pk AS (SELECT *, site_type <> 'lean_to' AND (contains(land, 'nation_2') OR contains(land, 'nation_16')) AS peaks FROM ft)
    SELECT site_id, region, basis, ft AS elevation_ft, CASE WHEN region IS NULL THEN 'unknown' WHEN gate = 'not_permitted' OR region = 'south' AND land IN ('nation_3', 'nation_8') THEN CASE WHEN basis IS NULL THEN 'not_permitted' ELSE 'unknown' END
        WHEN region = 'north' AND ft > 4050 AND basis IS NULL THEN 'not_permitted' WHEN region = 'north' AND ft >= 3950 THEN 'unknown' WHEN region = 'north' AND peaks AND ft > 3550 AND basis IS NULL THEN 'not_permitted' WHEN region = 'north' AND peaks AND ft >= 3450 THEN 'unknown'
        WHEN basis IS NOT NULL THEN CASE WHEN region = 'north' AND ft IS NULL THEN 'unknown' ELSE 'permitted' END ELSE 'unknown' END AS verdict,
        CASE WHEN region IS NULL THEN 'no_rules' WHEN gate = 'not_permitted' THEN 'closed' WHEN region = 'south' AND land IN ('nation_3', 'nation_8') THEN 'scenic' WHEN region = 'north' AND ft >= 3950 THEN 'all_4000' WHEN region = 'north' AND peaks AND ft >= 3450 THEN 'peaks_3500'
        WHEN basis IS NOT NULL THEN CASE WHEN region = 'north' AND ft IS NULL THEN 'no_elevation' ELSE 'designated' END
        WHEN region = 'south' AND contains(land, 'nation_1') AND trail_m < 60.96 - 15 THEN 'trail_200' WHEN region = 'south' AND contains(land, 'nation_1') AND trail_m < 60.96 + 15 THEN 'trail_200_margin'
        WHEN region = 'south' AND water_m < 60.96 - 15 THEN 'water_200' WHEN region = 'south' AND water_m < 60.96 + 15 THEN 'water_200_margin' ELSE 'undesignated' END AS reason FROM pk"""


@query("legality_verdict", sql(f"{LAND}, {SEGMENTS}, {NEAR_TRAIL}, {TRAIL}, {VERDICT_SQL}", "sites", "land", "vertices", "water"))
def legality_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The ordered decision list of the region that a site is in; without one there are no rules."""
    table, c = load(spark, d, "sites"), F.col
    water = spatial.within(table.select("site_id", "x_m", "y_m"), load(spark, d, "water").select("x_m", "y_m"), 1000.0).groupBy("site_id").agg(F.min("distance_m").alias("water_m"))
    sites = table.join(legal_factor(table, parcels(spark, d)), "site_id").join(trail_distance(spark, d), "site_id", "left").join(water, "site_id", "left")
    sites = sites.withColumn("basis", F.when(c("source") == "ridb", "listed by Recreation.gov").when(c("site_type") == "lean_to", "a lean-to")).withColumn("elevation_ft", F.bround(c("elevation_m") * FEET, 0).cast("long")).withColumn("region", region_at())
    said = F.struct(F.lit("unknown").alias("verdict"), F.lit("no_rules").alias("reason"))
    for region in REGIONS:
        said = F.when(c("region") == region["id"], decide(region)).otherwise(said)
    return sites.select("site_id", "region", "basis", "elevation_ft", said.alias("said")).select("site_id", "region", "basis", "elevation_ft", "said.verdict", "said.reason")


RATE = "sqrt(greatest(gain_m, loss_m) * 3.280839895013123 * 2 * length_m / 1609.344)"


@query("route_difficulty", sql(f"SELECT route_id, round({RATE}, 4) AS rating, CASE WHEN gain_m IS NULL THEN NULL WHEN {RATE} < 50 THEN 'Easy' WHEN {RATE} < 150 THEN 'Moderate' ELSE 'Hard' END AS band, round(length_m / 5000 * 3600 + gain_m / 600 * 3600, 6) AS seconds, CASE WHEN gain_m IS NULL THEN NULL ELSE round((length_m / 5000 * 60 + gain_m / 600 * 60) / 5) * 5 END AS minutes FROM (SELECT *, CASE WHEN gain_m IS NULL THEN NULL ELSE loss_m END AS l2 FROM routes)".replace("greatest(gain_m, loss_m)", "greatest(gain_m, l2)"), "routes"))
def route_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Rating by climb and length in the harder direction, its band, and walking time at 5 km/h and 600 m climb an hour."""
    c = F.col
    rating = F.when(c("gain_m").isNotNull(), F.sqrt(F.greatest("gain_m", "loss_m") * FEET * 2 * c("length_m") / 1609.344))
    return load(spark, d, "routes").select("route_id", F.round(rating, 4).alias("rating"), curves.bands(rating, [(50, "Easy"), (150, "Moderate")], "Hard").alias("band"), F.round(c("length_m") / 5000 * 3600 + c("gain_m") / 600 * 3600, 6).alias("seconds"), (F.round((c("length_m") / 5000 * 60 + c("gain_m") / 600 * 60) / 5) * 5).alias("minutes"))


@query("access_classes", sql("SELECT route_id, CASE WHEN length_m <= 3000 AND coalesce(gain_m, 0) <= 200 AND length_m / 5000 + coalesce(gain_m, 0) / 600 <= 1 THEN 'easy' WHEN length_m <= 10000 AND coalesce(gain_m, 0) <= 600 AND length_m / 5000 + coalesce(gain_m, 0) / 600 <= 3.5 THEN 'moderate' ELSE 'hard' END AS access FROM routes", "routes"))
def access_classes(spark: SparkSession, d: str) -> DataFrame:
    """The first class whose three limits all hold, limits included."""
    gain = F.coalesce("gain_m", F.lit(0.0))
    hours = F.col("length_m") / 5000 + gain / 600
    fits = lambda km, climb, most: (F.col("length_m") <= km * 1000) & (gain <= climb) & (hours <= most)
    return load(spark, d, "routes").select("route_id", F.when(fits(3, 200, 1), "easy").when(fits(10, 600, 3.5), "moderate").otherwise("hard").alias("access"))


#: How near the ends of a loop are, another trail and a lake; how high a summit stands and how near its top an end is.
LOOP_GAP, CONNECT, POND, RELIEF, TOP = 200.0, 30.0, 100.0, 100.0, 15.0
#: Ends of ways with a height that their nodes' numbers give.
ENDS_SQL = f"""z AS (SELECT *, CAST({h('node_id')} % 900 AS DOUBLE) AS z_m FROM vertices),
    w AS (SELECT way_id, arg_min(x_m, pos) AS x0, arg_min(y_m, pos) AS y0, arg_max(x_m, pos) AS x1, arg_max(y_m, pos) AS y1, arg_min(z_m, pos) AS z0, arg_max(z_m, pos) AS z1, min(z_m) AS low, max(z_m) AS high FROM z GROUP BY way_id HAVING count(*) > 1),
    ends AS (SELECT way_id, 0 AS side, x0 AS x_m, y0 AS y_m, z0 AS z, low, high FROM w UNION ALL SELECT way_id, 1, x1, y1, z1, low, high FROM w)"""
ON_SEG = "CASE WHEN length_m = 0 THEN 0 ELSE least(1e0, greatest(0e0, ((e.x_m - ax) * (bx - ax) + (e.y_m - ay) * (b_y - ay)) / (length_m * length_m))) END"
END_CLASS_SQL = f"""touch AS (SELECT DISTINCT e.way_id, e.side FROM ends e JOIN runs r ON r.way_id <> e.way_id AND e.x_m BETWEEN least(ax, bx) - 30 AND greatest(ax, bx) + 30 AND e.y_m BETWEEN least(ay, b_y) - 30 AND greatest(ay, b_y) + 30
        WHERE sqrt(pow(e.x_m - (ax + ({ON_SEG}) * (bx - ax)), 2) + pow(e.y_m - (ay + ({ON_SEG}) * (b_y - ay)), 2)) <= 30),
    lakes AS (SELECT DISTINCT way_id, side FROM ends e JOIN water f ON f.feature_type = 'lake' AND abs(e.x_m - f.x_m) <= 100 AND abs(e.y_m - f.y_m) <= 100 AND sqrt(pow(e.x_m - f.x_m, 2) + pow(e.y_m - f.y_m, 2)) <= 100),
    kinds AS (SELECT e.way_id, e.side, CASE WHEN high - low >= 100 AND z >= high - 15 THEN 'summit' WHEN t.way_id IS NOT NULL THEN 'connects' WHEN l.way_id IS NOT NULL THEN 'pond' ELSE 'dead_end' END AS kind FROM ends e LEFT JOIN touch t ON t.way_id = e.way_id AND t.side = e.side LEFT JOIN lakes l ON l.way_id = e.way_id AND l.side = e.side)"""


def end_classes(spark: SparkSession, d: str) -> DataFrame:
    """way_id, side (0 or 1), x_m, y_m and kind of both ends of each way: summit, connects, pond or dead_end, the first that fits."""
    c = F.col
    vertices = load(spark, d, "vertices")
    heights = vertices.withColumn("z_m", F.expr(f"CAST({h('node_id')} % 900 AS DOUBLE)"))
    first_last = [f(k, "pos").alias(f"{k}{n}") for k in ("x_m", "y_m", "z_m") for n, f in ((0, F.min_by), (1, F.max_by))]
    ways = heights.groupBy("way_id").agg(*first_last, F.min("z_m").alias("low"), F.max("z_m").alias("high"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    side = lambda k: F.struct(F.lit(k).alias("side"), c(f"x_m{k}").alias("x_m"), c(f"y_m{k}").alias("y_m"), c(f"z_m{k}").alias("z"))
    ends = ways.select("way_id", "low", "high", F.inline(F.array(side(0), side(1))))
    points = ends.select(c("way_id").alias("end_way"), "side", "x_m", "y_m")
    touch = spatial.nearest_segment(points, spatial.lines_of(vertices), ["end_way", "side"], CONNECT, apart=("end_way", "way_id")).select(c("end_way").alias("way_id"), "side", F.lit(True).alias("touches"))
    lakes = spatial.within(points, load(spark, d, "water").filter("feature_type = 'lake'").select("x_m", "y_m"), POND).select(c("end_way").alias("way_id"), "side").distinct().withColumn("lake", F.lit(True))
    kind = F.when((c("high") - c("low") >= RELIEF) & (c("z") >= c("high") - TOP), "summit").when(c("touches"), "connects").when(c("lake"), "pond").otherwise("dead_end")
    return ends.join(touch, ["way_id", "side"], "left").join(lakes, ["way_id", "side"], "left").select("way_id", "side", "x_m", "y_m", kind.alias("kind"))


@query("end_classes", sql(f"{SEGMENTS}, {ENDS_SQL}, {END_CLASS_SQL} SELECT way_id, side, kind FROM kinds", "vertices", "water"))
def end_classes_query(spark: SparkSession, d: str) -> DataFrame:
    return end_classes(spark, d).select("way_id", "side", "kind")


@query("route_types", sql(f"{SEGMENTS}, {ENDS_SQL}, {END_CLASS_SQL}, g AS (SELECT way_id, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS gap, a.kind AS at_start, b.kind AS at_end FROM w JOIN kinds a USING (way_id) JOIN kinds b USING (way_id) WHERE a.side = 0 AND b.side = 1) SELECT way_id, round(gap, 1) AS ends_apart_m, CASE WHEN gap <= 200 THEN 'loop' WHEN at_start IN ('summit', 'pond') OR at_end IN ('summit', 'pond') OR least(at_start, at_end) = 'connects' AND greatest(at_start, at_end) = 'dead_end' THEN 'out_and_back' ELSE 'point_to_point' END AS route_type, gap > 200 AS estimated FROM g", "vertices", "water"))
def route_types(spark: SparkSession, d: str) -> DataFrame:
    """A loop if the ends are near each other; otherwise an estimate from what the ends are at."""
    c = F.col
    at = lambda k, v: F.max(F.when(c("side") == k, c(v)))
    ways = end_classes(spark, d).groupBy("way_id").agg(at(0, "kind").alias("s"), at(1, "kind").alias("e"), F.sqrt(F.pow(at(1, "x_m") - at(0, "x_m"), 2) + F.pow(at(1, "y_m") - at(0, "y_m"), 2)).alias("gap"))
    back = c("s").isin("summit", "pond") | c("e").isin("summit", "pond") | (c("s") == "connects") & (c("e") == "dead_end") | (c("s") == "dead_end") & (c("e") == "connects")
    loop = c("gap") <= LOOP_GAP
    return ways.select("way_id", F.round("gap", 1).alias("ends_apart_m"), F.when(loop, "loop").when(back, "out_and_back").otherwise("point_to_point").alias("route_type"), (~loop).alias("estimated"))


@query("confidence_levels", sql("SELECT site_id, CASE WHEN source = 'ridb' THEN 'official' WHEN source <> 'osm' THEN 'limited_info' WHEN trim(coalesce(name, '')) <> '' OR n_tags >= 2 THEN 'community_mapped' ELSE 'limited_info' END AS level FROM (SELECT site_id, source, CASE WHEN site_id % 2 = 0 THEN name ELSE ' ' END AS name, CASE WHEN site_id % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN site_id % 7 < 3 THEN 1 ELSE 0 END AS n_tags FROM sites)", "sites"))
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    """By source; a mapped site needs a name or two tags that say something, blank values not counted."""
    site = F.col("site_id")
    tags = F.create_map(F.lit("fireplace"), F.when(site % 5 < 2, "yes").otherwise(" "), F.lit("capacity"), F.when(site % 7 < 3, "4").otherwise(""), F.lit("colour"), F.lit("green"))
    known = F.array(*(F.lit(k) for k in ("fireplace", "capacity", "reservation", "shelter_type")))
    n = F.size(F.map_filter(tags, lambda k, v: F.array_contains(known, k) & (F.trim(v) != "")))
    named = F.trim(F.when(site % 2 == 0, F.col("name")).otherwise(" ")) != ""
    level = F.when(F.col("source") == "ridb", "official").when(F.col("source") != "osm", "limited_info").when(named | (n >= 2), "community_mapped").otherwise("limited_info")
    return load(spark, d, "sites").select("site_id", level.alias("level"))


@query("user_weight_shares", "SELECT c_custkey AS user_id, k AS factor, CASE WHEN total = 0 THEN 0 ELSE round(100e0 * w / total) END AS share FROM (SELECT c_custkey, k, w, sum(w) OVER (PARTITION BY c_custkey) AS total FROM (SELECT c_custkey, k, (c_custkey * m) % 7 AS w FROM customer, (VALUES ('water', 1), ('trail', 2), ('slope', 3)) v(k, m)))")
def user_weight_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sliders as whole percentages, 0 when all are 0."""
    sliders = F.create_map(*(x for k, m in (("water", 1), ("trail", 2), ("slope", 3)) for x in (F.lit(k), (F.col("c_custkey") * m) % 7)))
    total = F.aggregate(F.map_values(sliders), F.lit(0).cast("long"), lambda a, x: a + x)
    shares = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), total.alias("total"), F.explode(sliders).alias("factor", "w"))
    return shares.select("user_id", "factor", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("w") / F.col("total"))).alias("share"))


@query("stale_factors", "SELECT c_custkey AS site_id, sha256(concat_ws('|', 'v1', CAST(c_custkey % 5 AS VARCHAR))) AS digest FROM customer WHERE c_custkey % 5 <> 2")
def stale_factors(spark: SparkSession, d: str) -> DataFrame:
    """Sites whose stored digest isn't that of the current configuration."""
    digest = lambda v: F.sha2(F.concat_ws("|", F.lit("v1"), v.cast("string")), 256)
    stored = load(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), digest(F.col("c_custkey") % 5).alias("digest"))
    return stored.filter(F.col("digest") != digest(F.lit(2)))


SUNRISE = -0.833
DAY_SQL = f"2 * degrees(acos(greatest(-1, least(1, (sin(radians({SUNRISE})) - sin(radians(lat)) * sin(dec)) / (cos(radians(lat)) * cos(dec)))))) / 15"


def day_length(lat: Column, day: Column) -> Column:
    """Hours from sunrise to sunset; the sun's centre is then under a flat horizon by refraction and its radius."""
    dec = F.radians(F.lit(23.44)) * F.sin(2 * F.pi() * (284 + day) / 365)
    x = (F.sin(F.radians(F.lit(SUNRISE))) - F.sin(F.radians(lat)) * F.sin(dec)) / (F.cos(F.radians(lat)) * F.cos(dec))
    return 2 * F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))) / 15


@query("day_lengths", f"SELECT lat, day, round({DAY_SQL}, 4) AS hours FROM (SELECT DISTINCT CAST(n_nationkey * 3 AS DOUBLE) AS lat, d.day, radians(23.44e0) * sin(2 * pi() * (284 + d.day) / 365) AS dec FROM nation, range(1, 366, 13) d(day))")
def day_lengths(spark: SparkSession, d: str) -> DataFrame:
    days = load(spark, d, "nation").select((F.col("n_nationkey") * 3.0).alias("lat"), F.explode(F.expr("sequence(1L, 365L, 13L)")).alias("day")).distinct()
    return days.select("lat", "day", F.round(day_length(F.col("lat"), F.col("day")), 4).alias("hours"))


@query("sun_hours", f"WITH s AS (SELECT c_custkey AS site_id, 20e0 + c_custkey % 40 AS lat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey * 37 % 130) / 100e0 END AS share, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE (c_custkey * 31 % 100) / 100e0 END AS morning FROM customer), season AS (SELECT lat, avg({DAY_SQL}) AS day_h FROM (SELECT lat, radians(23.44e0) * sin(2 * pi() * (284 + d.day) / 365) AS dec FROM (SELECT DISTINCT lat FROM s), range(152, 244) d(day)) GROUP BY lat), h AS (SELECT site_id, round(greatest(0, least(1, share)) * day_h, 1) AS hours, morning FROM s JOIN season USING (lat)) SELECT site_id, hours, CASE WHEN hours IS NULL THEN '' WHEN hours >= 12 THEN 'full' WHEN hours >= 8 THEN 'partial' ELSE 'low' END AS level, morning >= 0.5 AS morning_sun FROM (SELECT site_id, CASE WHEN site_id % 9 = 0 THEN NULL ELSE hours END AS hours, morning FROM h)")
def sun_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours of direct sun on a day in the season, June to August, their level, and whether the morning is lit for half its time."""
    k = F.col("c_custkey")
    sites = load(spark, d, "customer").select(k.alias("site_id"), (20.0 + k % 40).alias("lat"), F.when(k % 9 != 0, (k * 37 % 130) / 100.0).alias("share"), F.when(k % 8 != 0, (k * 31 % 100) / 100.0).alias("morning"))
    days = F.transform(F.sequence(F.lit(152), F.lit(243)), lambda day: day_length(F.col("lat"), day))
    season = F.aggregate(days, F.lit(0.0), lambda a, x: a + x) / F.size(days)
    share = F.when(F.col("share").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share"))))
    hours = sites.withColumn("hours", F.round(share * season, 1))
    level = F.when(F.col("hours").isNull(), "").when(F.col("hours") >= 12, "full").when(F.col("hours") >= 8, "partial").otherwise("low")
    return hours.select("site_id", "hours", level.alias("level"), (F.col("morning") >= 0.5).alias("morning_sun"))
