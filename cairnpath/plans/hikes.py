"""Queries over recorded hikes: moving time, stops, progress along a trail, and what is left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.operators import spatial
from cairnpath.plans.registry import query
from cairnpath.plans.series import FILL, filled, threshold_climb
from cairnpath.plans.spatial import NEAR_SEG, SEGMENTS
from cairnpath.sources.fixtures import h, load, sql

#: Metres within which a hiker stands, seconds that make it a stop; metres off a trail that warn; metres and seconds walked before pace is believed.
STAND_M, STOP_S, OFF_TRAIL_M, PACE_M, PACE_S = 15.0, 60, 75.0, 400.0, 300
#: Tracks that stand for nine fixes of ten seconds and then go on by 50 m.
PAUSES = f"SELECT user_id AS track_id, pos, pos * 10 AS t_s, floor(pos / 9e0) * 50e0 + CAST({h('event_id')} % 80 AS DOUBLE) / 10e0 AS x_m, CAST({h('event_id * 3 + 1')} % 80 AS DOUBLE) / 10e0 AS y_m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def moving(track: Column) -> Column:
    """An ordered array of fixes (t_s, x_m, y_m) -> moving_s and stops: a stretch within 15 m of where it began is a stop from a minute on."""
    first = F.element_at(track, 1)
    zero = F.struct(first["x_m"].alias("x"), first["y_m"].alias("y"), first["t_s"].alias("since"), first["t_s"].alias("last"), F.lit(0).cast("long").alias("moving"), F.lit(0).alias("stops"))

    def closed(a: Column, end: Column) -> tuple[Column, Column]:
        span = end - a["since"]
        return F.when(span >= STOP_S, a["moving"]).otherwise(a["moving"] + span), F.when(span >= STOP_S, a["stops"] + 1).otherwise(a["stops"])

    def step(a: Column, f: Column) -> Column:
        dx, dy = f["x_m"] - a["x"], f["y_m"] - a["y"]
        went = F.sqrt(dx * dx + dy * dy) > STAND_M
        time, stops = closed(a, a["last"])
        pick = lambda new, old: F.when(went, new).otherwise(old)
        return F.struct(pick(f["x_m"], a["x"]).alias("x"), pick(f["y_m"], a["y"]).alias("y"), pick(f["t_s"], a["since"]).alias("since"), f["t_s"].alias("last"), pick(time + f["t_s"] - a["last"], a["moving"]).alias("moving"), pick(stops, a["stops"]).alias("stops"))

    def end(a: Column) -> Column:
        time, stops = closed(a, a["last"])
        return F.struct(time.alias("moving_s"), stops.alias("stops"))

    return F.aggregate(track, zero, step, end)


MOVING = f"fx AS ({PAUSES}), r AS (SELECT track_id, pos, x_m AS x, y_m AS y, t_s AS since, t_s AS last, CAST(0 AS BIGINT) AS moving, 0 AS stops FROM fx WHERE pos = 1 UNION ALL SELECT track_id, pos, CASE WHEN went THEN x_m ELSE x END, CASE WHEN went THEN y_m ELSE y END, CASE WHEN went THEN t_s ELSE since END, t_s, CASE WHEN went THEN moving + (CASE WHEN last - since >= 60 THEN 0 ELSE last - since END) + t_s - last ELSE moving END, CASE WHEN went AND last - since >= 60 THEN stops + 1 ELSE stops END FROM (SELECT fx.*, r.x, r.y, r.since, r.last, r.moving, r.stops, sqrt((x_m - x) * (x_m - x) + (y_m - y) * (y_m - y)) > 15 AS went FROM r JOIN fx ON fx.track_id = r.track_id AND fx.pos = r.pos + 1)), e AS (SELECT track_id, arg_max(moving + CASE WHEN last - since >= 60 THEN 0 ELSE last - since END, pos) AS moving_s, arg_max(stops + CASE WHEN last - since >= 60 THEN 1 ELSE 0 END, pos) AS stops FROM r GROUP BY track_id)"


def pauses(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return spark.sql(PAUSES.replace("FROM events)", "FROM {events})"), events=events)


@query("moving_time", "WITH RECURSIVE " + MOVING + " SELECT track_id, moving_s, stops FROM e")
def moving_time(spark: SparkSession, d: str) -> DataFrame:
    tracks = pauses(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t_s", "x_m", "y_m"))).alias("track"))  # of one hike
    return tracks.select("track_id", moving(F.col("track")).alias("m")).select("track_id", "m.moving_s", "m.stops")


@query("hike_stats", "WITH RECURSIVE " + MOVING + ", w AS (SELECT track_id, pos, x_m AS ax, y_m AS ay, 0e0 AS metres, t_s AS at FROM fx WHERE pos = 1 UNION ALL SELECT track_id, pos, CASE WHEN far >= 10 THEN x_m ELSE ax END, CASE WHEN far >= 10 THEN y_m ELSE ay END, CASE WHEN far >= 10 AND far / (t_s - since_s) <= 7 THEN metres + far ELSE metres END, CASE WHEN far >= 10 THEN t_s ELSE since_s END FROM (SELECT fx.*, w.ax, w.ay, w.metres, w.at AS since_s, sqrt((x_m - ax) * (x_m - ax) + (y_m - ay) * (y_m - ay)) AS far FROM w JOIN fx ON fx.track_id = w.track_id AND fx.pos = w.pos + 1)), d AS (SELECT track_id, max(metres) AS metres FROM w GROUP BY track_id), el AS (SELECT track_id, max(t_s) - min(t_s) AS elapsed_s FROM fx GROUP BY track_id) SELECT track_id, elapsed_s, least(moving_s, elapsed_s) AS moving_s, stops, round(metres, 2) AS distance_m, CASE WHEN metres >= 50 AND moving_s > 0 THEN round(least(moving_s, elapsed_s) / 60e0 / (metres / 1609.344), 3) END AS pace_min_mi FROM e JOIN d USING (track_id) JOIN el USING (track_id)".replace("t_s AS at FROM", "t_s AS since0 FROM").replace("w.at AS since_s", "w.since0 AS since_s"))
def hike_stats(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed and moving time, stops, metres walked in steps of 10 m, and minutes a mile while moving once 50 m are walked."""
    from cairnpath.plans.series import walked

    c = F.col
    tracks = pauses(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t_s", "x_m", "y_m"))).alias("track"))  # of one hike
    elapsed = F.element_at("track", -1)["t_s"] - F.element_at("track", 1)["t_s"]
    stats = tracks.select("track_id", elapsed.alias("elapsed_s"), moving(c("track")).alias("m"), walked(c("track")).alias("metres"))
    time = F.least("m.moving_s", "elapsed_s")
    pace = F.when((c("metres") >= 50) & (c("m.moving_s") > 0), F.round(time / 60.0 / (c("metres") / 1609.344), 3))
    return stats.select("track_id", "elapsed_s", time.alias("moving_s"), "m.stops", F.round("metres", 2).alias("distance_m"), pace.alias("pace_min_mi"))


@query("climb_left", sql(FILL + ", ends AS (SELECT line_id, max(along_m) AS len FROM filled GROUP BY line_id), q AS (SELECT line_id, round(len * ((line_id % 10) / 10e0), 3) AS at_m, CASE WHEN round(len * ((line_id % 10) / 10e0), 3) <= len / 2 THEN 1 ELSE -1 END AS dir FROM ends), o AS (SELECT f.line_id, dir, z, row_number() OVER (PARTITION BY f.line_id ORDER BY dir * along_m) AS k FROM filled f JOIN q ON q.line_id = f.line_id AND (CASE WHEN dir = 1 THEN along_m >= at_m ELSE along_m <= at_m END)), r AS (SELECT line_id, dir, k, z AS ref, 0e0 AS gain FROM o WHERE k = 1 UNION ALL SELECT o.line_id, o.dir, o.k, CASE WHEN abs(o.z - ref) >= 3 THEN o.z ELSE ref END, CASE WHEN o.z - ref >= 3 THEN gain + o.z - ref ELSE gain END FROM r JOIN o ON o.line_id = r.line_id AND o.k = r.k + 1) SELECT line_id, dir AS direction, round(max(gain), 3) AS gain_m FROM r GROUP BY line_id, dir", "profile").replace("WITH ", "WITH RECURSIVE ", 1))
def climb_left(spark: SparkSession, d: str) -> DataFrame:
    """Which way a hike walks, from the nearer end, and the climb that is left that way, rises from 3 m on."""
    c = F.col
    lines = filled(load(spark, d, "profile")).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("along_m", "z"))).alias("v"))  # of one line
    lines = lines.withColumn("len", F.element_at("v", -1)["along_m"]).withColumn("at_m", F.round(c("len") * ((c("line_id") % 10) / 10.0), 3))
    lines = lines.withColumn("direction", F.when(c("at_m") <= c("len") / 2, 1).otherwise(-1))
    ahead = F.transform(F.filter("v", lambda x: F.when(c("direction") == 1, x["along_m"] >= c("at_m")).otherwise(x["along_m"] <= c("at_m"))), lambda x: x["z"])
    values = F.when(c("direction") == 1, ahead).otherwise(F.reverse(ahead))
    return lines.select("line_id", "direction", threshold_climb(values, 3.0)["gain"].alias("g")).select("line_id", "direction", F.round("g", 3).alias("gain_m"))


PROGRESS = f"{SEGMENTS}, {NEAR_SEG.replace('1000', '500')}, len AS (SELECT way_id, sum(length_m) AS way_m FROM segs GROUP BY way_id), b AS (SELECT site_id, arg_min(way_id, struct_pack(a := round(d, 6), b := way_id, c := pos)) AS way_id, min(d) AS off_m, arg_min(before_m + t * length_m, struct_pack(a := round(d, 6), b := way_id, c := pos)) AS along_m FROM hits WHERE d <= 500 GROUP BY site_id), p AS (SELECT b.*, way_m, CASE WHEN along_m <= way_m / 2 THEN 1 ELSE -1 END AS dir FROM b JOIN len USING (way_id)), ah AS (SELECT p.site_id, q.site_id AS stop, (q.along_m - p.along_m) * p.dir AS ahead_m FROM p JOIN b q ON q.way_id = p.way_id AND (q.along_m - p.along_m) * p.dir > 0), n AS (SELECT site_id, array_to_string(list_slice(list(stop ORDER BY round(ahead_m, 6), stop), 1, 3), ',') AS next_stops FROM ah GROUP BY site_id)"


@query("trail_progress", sql(f"{PROGRESS} SELECT site_id, way_id, dir AS direction, round(CASE WHEN dir = 1 THEN along_m ELSE way_m - along_m END, 2) AS done_m, round(greatest(0, way_m - CASE WHEN dir = 1 THEN along_m ELSE way_m - along_m END), 2) AS left_m, off_m > 75 AS off_trail, CASE WHEN site_id % 2 = 0 THEN 'pace' ELSE 'naismith' END AS eta_basis, round(greatest(0, way_m - CASE WHEN dir = 1 THEN along_m ELSE way_m - along_m END) * CASE WHEN site_id % 2 = 0 THEN (600e0 + site_id % 100) / 500 / 60 ELSE 60e0 / 5000 END, 2) AS eta_min, next_stops FROM p LEFT JOIN n USING (site_id)", "sites", "vertices"))
def trail_progress(spark: SparkSession, d: str) -> DataFrame:
    """A hiker's place on the nearest way: done and left in the walking direction, off the trail or not, time left by own pace once it can be believed, else by the rule of 5 km/h, and the next three stops."""
    c = F.col
    first = F.min(F.struct(F.round("distance_m", 6).alias("off"), "way_id", "pos", c("distance_m").alias("off_m"), (c("before_m") + c("t") * c("length_m")).alias("along_m"), "way_m")).alias("b")
    place = spatial.nearest_segment(load(spark, d, "sites").select("site_id", "x_m", "y_m"), spatial.lines_of(load(spark, d, "vertices", "l_orderkey")), ["site_id"], 500.0, first).select("site_id", "b.way_id", "b.off_m", "b.along_m", "b.way_m")
    place = place.withColumn("direction", F.when(c("along_m") <= c("way_m") / 2, 1).otherwise(-1))
    # Stops at the same place of a way are one row with the first three of them; the next ones are in the three rows ahead.
    first = place.withColumn("k", F.row_number().over(Window.partitionBy("way_id", "along_m").orderBy("site_id"))).filter("k <= 3")
    spots = first.groupBy("way_id", "along_m").agg(F.array_sort(F.collect_list("site_id")).alias("here"))
    ahead = lambda order: F.slice(F.flatten(F.array_compact(F.array(*(F.lead("here", n).over(Window.partitionBy("way_id").orderBy(order)) for n in (1, 2, 3))))), 1, 3)
    spots = spots.select("way_id", "along_m", ahead(c("along_m").asc()).alias("forth"), ahead(c("along_m").desc()).alias("back"))
    next_ = F.when(c("direction") == 1, c("forth")).otherwise(c("back"))
    stops = place.join(spots, ["way_id", "along_m"]).withColumn("next", next_).filter(F.size("next") > 0).select("site_id", F.array_join(F.transform("next", lambda x: x.cast("string")), ",").alias("next_stops"))
    done = F.when(c("direction") == 1, c("along_m")).otherwise(c("way_m") - c("along_m"))
    left = F.greatest(F.lit(0.0), c("way_m") - done)
    # Every other hiker has walked 500 m in 600 s or more; the others too little to tell.
    walked_m, walked_s = F.when(c("site_id") % 2 == 0, 500.0).otherwise(100.0), (600 + c("site_id") % 100).cast("double")
    paced = (walked_m >= PACE_M) & (walked_s >= PACE_S)
    eta = left * F.when(paced, walked_s / walked_m / 60).otherwise(60.0 / 5000)
    return place.join(stops, "site_id", "left").select("site_id", "way_id", "direction", F.round(done, 2).alias("done_m"), F.round(left, 2).alias("left_m"), (c("off_m") > OFF_TRAIL_M).alias("off_trail"), F.when(paced, "pace").otherwise("naismith").alias("eta_basis"), F.round(eta, 2).alias("eta_min"), "next_stops")


@query("hike_gpx", "WITH o AS (SELECT user_id, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM o), s AS (SELECT user_id, seg, '<trkseg>' || string_agg('<trkpt lat=\"' || format('{:.6f}', 43 + (event_id % 1000) / 1e4) || '\" lon=\"' || format('{:.6f}', -76 + (event_id % 777) / 1e4) || '\"><ele>' || format('{:.1f}', floor(value)) || '</ele></trkpt>', '' ORDER BY ts, event_id) || '</trkseg>' AS x FROM g GROUP BY user_id, seg) SELECT user_id AS track_id, '<gpx version=\"1.1\" creator=\"cairnpath\" xmlns=\"http://www.topografix.com/GPX/1/1\"><trk><name>Hike ' || user_id || '</name>' || string_agg(x, '' ORDER BY seg) || '</trk></gpx>' AS gpx, count(*) AS segments FROM s GROUP BY user_id")
def hike_gpx(spark: SparkSession, d: str) -> DataFrame:
    """A GPX document of each hike, a segment for each stretch between pauses; heights stand with their points."""
    c, w = F.col, Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.lag(F.unix_micros(c("ts").cast("timestamp"))).over(w)
    cut = load(spark, d, "events").withColumn("fresh", F.when(gap <= 12 * 3600 * 1_000_000, 0).otherwise(1)).withColumn("seg", F.sum("fresh").over(w))
    point = F.concat(F.lit('<trkpt lat="'), F.format_string("%.6f", 43 + (c("event_id") % 1000) / 1e4), F.lit('" lon="'), F.format_string("%.6f", -76 + (c("event_id") % 777) / 1e4), F.lit('"><ele>'), F.format_string("%.1f", F.floor("value").cast("double")), F.lit("</ele></trkpt>"))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, value.alias("v")))), lambda x: x["v"]), "")  # noqa: E731  of one hike
    parts = cut.groupBy("user_id", "seg").agg(ordered(("ts", "event_id"), point).alias("points")).withColumn("x", F.concat(F.lit("<trkseg>"), "points", F.lit("</trkseg>")))
    hikes = parts.groupBy("user_id").agg(ordered(("seg",), c("x")).alias("body"), F.count(F.lit(1)).alias("segments"))
    return hikes.select(c("user_id").alias("track_id"), F.concat(F.lit('<gpx version="1.1" creator="cairnpath" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Hike '), c("user_id").cast("string"), F.lit("</name>"), "body", F.lit("</trk></gpx>")).alias("gpx"), "segments")
