"""Queries over ordered series: elevation profiles and recorded tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.functions.curves import rounded
from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import load, sql


def line():
    return Window.partitionBy("line_id").orderBy("pos")


FILL = """b AS (SELECT *, last_value(CASE WHEN z_m IS NOT NULL THEN along_m END IGNORE NULLS) OVER w AS a0, last_value(z_m IGNORE NULLS) OVER w AS z0, first_value(CASE WHEN z_m IS NOT NULL THEN along_m END IGNORE NULLS) OVER v AS a1, first_value(z_m IGNORE NULLS) OVER v AS z1 FROM profile
        WINDOW w AS (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY line_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT line_id, pos, along_m, CASE WHEN z_m IS NOT NULL THEN z_m WHEN z0 IS NULL THEN z1 WHEN z1 IS NULL THEN z0 ELSE z0 + (z1 - z0) * (along_m - a0) / (a1 - a0) END AS z FROM b),
    smooth AS (SELECT line_id, pos, along_m, z, avg(z) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM filled)"""


def filled(profile: DataFrame) -> DataFrame:
    """Gaps closed linearly, ends carried on; a line without any value keeps its nulls."""
    known = F.when(F.col("z_m").isNotNull(), F.col("along_m"))
    back, on = line().rowsBetween(Window.unboundedPreceding, 0), line().rowsBetween(0, Window.unboundedFollowing)
    a0, z0, a1, z1 = F.last(known, True).over(back), F.last("z_m", True).over(back), F.first(known, True).over(on), F.first("z_m", True).over(on)
    z = F.when(F.col("z_m").isNotNull(), F.col("z_m")).when(z0.isNull(), z1).when(z1.isNull(), z0).otherwise(z0 + (z1 - z0) * (F.col("along_m") - a0) / (a1 - a0))
    return profile.withColumn("z", z).select("line_id", "pos", "along_m", "z")


def smoothed(profile: DataFrame, half: int = 2) -> DataFrame:
    return filled(profile).withColumn("s", F.avg("z").over(line().rowsBetween(-half, half)))


@query("profile_smoothed", sql(FILL + " SELECT line_id, pos, round(z, 6) AS z, round(s, 6) AS s FROM smooth", "profile"))
def profile_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return smoothed(load(spark, d, "profile")).select("line_id", F.col("pos").cast("long").alias("pos"), F.round("z", 6).alias("z"), F.round("s", 6).alias("s"))


@query("profile_stats", sql(FILL + ", st AS (SELECT *, s - lag(s) OVER (PARTITION BY line_id ORDER BY pos) AS dz FROM smooth) SELECT line_id, count(*) AS samples, round(max(s), 4) AS high_m, round(arg_max(along_m, struct_pack(a := round(s, 9), b := -pos)), 2) AS high_at_m, round(min(s), 4) AS low_m, round(arg_min(along_m, struct_pack(a := round(s, 9), b := pos)), 2) AS low_at_m, round(arg_min(s, pos), 4) AS start_m, round(arg_max(s, pos), 4) AS end_m, round(coalesce(sum(CASE WHEN dz > 0 THEN dz END), 0), 3) AS naive_gain_m, round(coalesce(sum(CASE WHEN dz < 0 THEN -dz END), 0), 3) AS naive_loss_m FROM st GROUP BY line_id", "profile"))
def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    steps = smoothed(load(spark, d, "profile")).withColumn("dz", F.col("s") - F.lag("s").over(line()))
    rank = lambda sign: F.struct(F.round("s", 9), sign * F.col("pos"))
    some = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3)
    return steps.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.max("s"), 4).alias("high_m"), F.round(F.max_by("along_m", rank(-1)), 2).alias("high_at_m"), F.round(F.min("s"), 4).alias("low_m"), F.round(F.min_by("along_m", rank(1)), 2).alias("low_at_m"),
        F.round(F.min_by("s", "pos"), 4).alias("start_m"), F.round(F.max_by("s", "pos"), 4).alias("end_m"), some(F.when(F.col("dz") > 0, F.col("dz"))).alias("naive_gain_m"), some(F.when(F.col("dz") < 0, -F.col("dz"))).alias("naive_loss_m"),
    )


def threshold_climb(values: Column, threshold: float) -> Column:
    """gain and loss of an ordered array; a change counts once it is as much as the threshold away from the last counted value."""
    zero = F.struct(F.element_at(values, 1).alias("ref"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(a: Column, v: Column) -> Column:
        up, down = v - a["ref"] >= threshold, a["ref"] - v >= threshold
        return F.struct(F.when(up | down, v).otherwise(a["ref"]).alias("ref"), F.when(up, a["gain"] + v - a["ref"]).otherwise(a["gain"]).alias("gain"), F.when(down, a["loss"] + a["ref"] - v).otherwise(a["loss"]).alias("loss"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), zero, step)


def ordered(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """A series as an array in the order of pos; a series is one track or line."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col(value) if isinstance(value, str) else value).alias("v")))), lambda x: x["v"]).alias("values"))


CLIMB = """WITH RECURSIVE p AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value AS z FROM events),
    r AS (SELECT line_id, pos, z AS ref, 0e0 AS gain, 0e0 AS loss FROM p WHERE pos = 1 UNION ALL
        SELECT p.line_id, p.pos, CASE WHEN abs(z - ref) >= 30 THEN z ELSE ref END, CASE WHEN z - ref >= 30 THEN gain + z - ref ELSE gain END, CASE WHEN ref - z >= 30 THEN loss + ref - z ELSE loss END FROM r JOIN p ON p.line_id = r.line_id AND p.pos = r.pos + 1)
    SELECT line_id, round(max(gain), 3) AS gain_m, round(max(loss), 3) AS loss_m FROM r GROUP BY line_id"""


@query("threshold_gain_loss", CLIMB)
def threshold_gain_loss(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, d, "events").select(F.col("user_id").alias("line_id"), F.row_number().over(order).alias("pos"), "value")
    climb = threshold_climb(F.col("values"), 30.0)
    return ordered(events, "line_id", "value").select("line_id", climb.alias("c")).select("line_id", F.round("c.gain", 3).alias("gain_m"), F.round("c.loss", 3).alias("loss_m"))


@query("max_grade", sql(FILL + ", g AS (SELECT a.line_id, a.along_m, round(100 * abs(b.s - a.s) / (b.along_m - a.along_m), 9) AS grade FROM smooth a JOIN smooth b USING (line_id) WHERE b.pos = a.pos + 4) SELECT line_id, round(max(grade), 4) AS max_grade_pct, round(arg_max(along_m, struct_pack(a := grade, b := -along_m)), 1) AS at_m FROM g GROUP BY line_id", "profile"))
def max_grade(spark: SparkSession, d: str) -> DataFrame:
    """The steepest window of 100 m in percent, and where it begins: of each sample the first one as far on, found by a range frame."""
    from_here = Window.partitionBy("line_id").orderBy("along_m").rangeBetween(100, Window.unboundedFollowing)
    ahead = F.first(F.struct("along_m", "s")).over(from_here)
    steps = smoothed(load(spark, d, "profile")).withColumn("to", ahead).filter("to IS NOT NULL")
    grade = F.round(100 * F.abs(F.col("to.s") - F.col("s")) / (F.col("to.along_m") - F.col("along_m")), 9)
    best = steps.groupBy("line_id").agg(F.max(F.struct(grade.alias("grade"), (-F.col("along_m")).alias("back"))).alias("b"))
    return best.select("line_id", F.round("b.grade", 4).alias("max_grade_pct"), F.round(-F.col("b.back"), 1).alias("at_m"))


@query("trailing_mean", sql(FILL + " SELECT line_id, pos, round(avg(z) OVER (PARTITION BY line_id ORDER BY along_m RANGE BETWEEN 75 PRECEDING AND CURRENT ROW), 6) AS mean_m FROM filled", "profile"))
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    frame = Window.partitionBy("line_id").orderBy("along_m").rangeBetween(-75, 0)
    return filled(load(spark, d, "profile")).select("line_id", F.col("pos").cast("long").alias("pos"), F.round(F.avg("z").over(frame), 6).alias("mean_m"))


@query("sparkline", sql(FILL + ", n AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM filled), e AS (SELECT line_id, k, n, z, pos, CAST(floor(k * (n / 32e0)) AS BIGINT) AS lo, CAST(floor((k + 1) * (n / 32e0)) AS BIGINT) AS hi FROM n, range(32) r(k)) SELECT line_id, k AS bucket, round(avg(z), 4) AS mean_m FROM e WHERE n > 32 AND pos - 1 >= lo AND pos - 1 < greatest(hi, lo + 1) GROUP BY ALL UNION ALL SELECT line_id, pos - 1, round(z, 4) FROM n WHERE n <= 32", "profile"))
def sparkline(spark: SparkSession, d: str) -> DataFrame:
    """32 means from int(k * n / 32) to int((k + 1) * n / 32); a series no longer than that as it is."""
    n = F.count(F.lit(1)).over(Window.partitionBy("line_id"))
    step = F.col("n") / 32.0
    at = F.col("pos") - 1
    edge = lambda k: F.floor(k * step)
    # A sample is in the bucket by its quotient, or in one beside it.
    near = F.floor(at / step)
    buckets = F.filter(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < 32) & (at >= edge(k)) & (at < F.greatest(edge(k + 1), edge(k) + 1)))
    series = filled(load(spark, d, "profile")).withColumn("n", n)
    means = series.filter("n > 32").withColumn("bucket", F.explode(buckets)).groupBy("line_id", "bucket").agg(F.round(F.avg("z"), 4).alias("mean_m"))
    return means.unionByName(series.filter("n <= 32").select("line_id", at.cast("long").alias("bucket"), F.round("z", 4).alias("mean_m")))


@query("nearest_rank_percentiles", sql(FILL + ", r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY z, pos) - 1 AS k, count(*) OVER (PARTITION BY line_id) AS n FROM filled) SELECT line_id, round(max(CASE WHEN k = CAST(round_even(0.5e0 * (n - 1), 0) AS BIGINT) THEN z END), 4) AS p50, round(max(CASE WHEN k = CAST(round_even(0.95e0 * (n - 1), 0) AS BIGINT) THEN z END), 4) AS p95 FROM r GROUP BY line_id", "profile"))
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line_id")
    ranked = filled(load(spark, d, "profile")).withColumn("k", F.row_number().over(w.orderBy("z", "pos")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda q: F.round(F.max(F.when(F.col("k") == F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long"), F.col("z"))), 4)
    return ranked.groupBy("line_id").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def between_samples(profile: DataFrame, cuts: DataFrame) -> DataFrame:
    """profile (line_id, along_m, z) and cuts (line_id, cut, at: within the profile) -> line_id, cut, z.

    An as-of merge: cuts and samples in one order, the sample before and the one after each.
    """
    both = profile.select("line_id", "along_m", "z", F.lit(None).cast("double").alias("cut")).unionByName(cuts.select("line_id", F.col("at").alias("along_m"), F.lit(None).cast("double").alias("z"), "cut"))
    w = Window.partitionBy("line_id").orderBy("along_m", F.col("cut").asc_nulls_first())
    sample = F.when(F.col("cut").isNull(), F.struct("along_m", "z"))
    near = both.withColumn("a", F.last(sample, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(sample, True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("cut IS NOT NULL")
    z = F.when(F.col("b").isNull() | (F.col("b.along_m") == F.col("a.along_m")), F.col("a.z")).otherwise(F.col("a.z") + (F.col("b.z") - F.col("a.z")) * (F.col("along_m") - F.col("a.along_m")) / (F.col("b.along_m") - F.col("a.along_m")))
    return near.select("line_id", "cut", F.round(z, 4).alias("z"))


@query("value_at_cuts", sql(FILL + ", cuts AS (SELECT line_id, cut FROM (SELECT DISTINCT line_id FROM profile), (VALUES (0e0), (60e0), (333e0), (1010e0), (99999e0)) v(cut)), ends AS (SELECT line_id, min(along_m) AS lo, max(along_m) AS hi FROM filled GROUP BY line_id), x AS (SELECT line_id, cut, least(greatest(cut, lo), hi) AS q FROM cuts JOIN ends USING (line_id)) SELECT line_id, cut, round(arg_max(z, CASE WHEN along_m <= q THEN along_m END) + (coalesce(arg_min(z, CASE WHEN along_m > q THEN along_m END), arg_max(z, along_m)) - arg_max(z, CASE WHEN along_m <= q THEN along_m END)) * (any_value(q) - max(CASE WHEN along_m <= q THEN along_m END)) / 25, 4) AS z FROM x JOIN filled USING (line_id) GROUP BY line_id, cut", "profile"))
def value_at_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Profile values between samples; beyond its ends those of the ends."""
    profile = filled(load(spark, d, "profile"))
    cuts = profile.groupBy("line_id").agg(F.max("along_m").alias("hi")).withColumn("cut", F.explode(F.array(*(F.lit(x) for x in (0.0, 60.0, 333.0, 1010.0, 99999.0)))))
    return between_samples(profile, cuts.withColumn("at", F.least("cut", "hi")))


#: Fixed value: how far beyond a profile's ends, in metres, it still has a value.
BEYOND_M = 0.5


@query("value_in_profile", sql(FILL + """, ends AS (SELECT line_id, min(along_m) AS lo, max(along_m) AS hi FROM filled GROUP BY line_id),
    cuts AS (SELECT line_id, lo, hi, unnest([-10e0, -0.4e0, 60e0, 333e0, hi - 7, hi + 0.3, hi + 2]) AS cut FROM ends),
    x AS (SELECT *, least(greatest(cut, lo), hi) AS q, row_number() OVER () AS k FROM cuts WHERE cut >= lo - 0.5 AND cut <= hi + 0.5),
    v AS (SELECT k, any_value(line_id) AS line_id, any_value(cut) AS cut, round(arg_max(z, CASE WHEN along_m <= q THEN along_m END) + (coalesce(arg_min(z, CASE WHEN along_m > q THEN along_m END), arg_max(z, along_m)) - arg_max(z, CASE WHEN along_m <= q THEN along_m END)) * (any_value(q) - max(CASE WHEN along_m <= q THEN along_m END)) / 25, 4) AS z FROM x JOIN filled USING (line_id) GROUP BY k)
    SELECT c.line_id, round(c.cut, 3) AS cut, z FROM cuts c LEFT JOIN v ON v.line_id = c.line_id AND v.cut = c.cut""", "profile"))  # fmt: skip
def value_in_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile values between samples; null half a metre and more outside it."""
    profile = filled(load(spark, d, "profile"))
    ends = profile.groupBy("line_id").agg(F.min("along_m").alias("lo"), F.max("along_m").alias("hi"))
    cuts = ends.withColumn("cut", F.explode(F.array(F.lit(-10.0), F.lit(-0.4), F.lit(60.0), F.lit(333.0), F.col("hi") - 7, F.col("hi") + 0.3, F.col("hi") + 2)))
    near = F.col("cut").between(F.col("lo") - BEYOND_M, F.col("hi") + BEYOND_M)
    found = between_samples(profile, cuts.filter(near).withColumn("at", F.least(F.greatest("cut", "lo"), "hi")))
    return cuts.select("line_id", "cut").join(found, ["line_id", "cut"], "left").select("line_id", F.round("cut", 3).alias("cut"), "z")


@query("cumulative_distance", sql("SELECT way_id, pos, round(coalesce(sum(step) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0), 3) AS along_m FROM (SELECT *, sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)) AS step FROM vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos))", "vertices"))
def cumulative_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("way_id").orderBy("pos")
    dx, dy = F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)
    return load(spark, d, "vertices").withColumn("step", F.sqrt(dx * dx + dy * dy)).select("way_id", F.col("pos").cast("long").alias("pos"), F.round(F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), 3).alias("along_m"))


#: Places where days end, as shares of a line's length; climbs count from 3 m on.
CUTS, THRESHOLD = (0.0, 0.37, 0.71, 1.0), 3.0
DAYS_SQL = """ends AS (SELECT line_id, max(along_m) AS len FROM smooth GROUP BY line_id), cuts AS (SELECT line_id, day, len * lo AS start_m, len * hi AS end_m FROM ends, (VALUES (0, 0e0, 0.37e0), (1, 0.37e0, 0.71e0), (2, 0.71e0, 1e0)) v(day, lo, hi)),
    edge AS (SELECT c.line_id, day, cut_m, arg_max(p.s, p.along_m) + (coalesce(any_value(q.s), arg_max(p.s, p.along_m)) - arg_max(p.s, p.along_m)) * (any_value(cut_m) - max(p.along_m)) / 25 AS z FROM (SELECT line_id, day, start_m AS cut_m FROM cuts UNION ALL SELECT line_id, day, end_m FROM cuts) c JOIN smooth p ON p.line_id = c.line_id AND p.along_m <= cut_m AND p.along_m > cut_m - 25 LEFT JOIN smooth q ON q.line_id = c.line_id AND q.along_m > cut_m AND q.along_m <= cut_m + 25 GROUP BY c.line_id, day, cut_m),
    series AS (SELECT line_id, day, cut_m AS m, z FROM edge UNION ALL SELECT c.line_id, day, along_m, s FROM cuts c JOIN smooth p ON p.line_id = c.line_id AND along_m > start_m AND along_m < end_m),
    o AS (SELECT *, row_number() OVER (PARTITION BY line_id, day ORDER BY m) AS k FROM series),
    r AS (SELECT line_id, day, k, z AS ref, 0e0 AS gain, 0e0 AS loss FROM o WHERE k = 1 UNION ALL SELECT o.line_id, o.day, o.k, CASE WHEN abs(o.z - ref) >= 3 THEN o.z ELSE ref END, CASE WHEN o.z - ref >= 3 THEN gain + o.z - ref ELSE gain END, CASE WHEN ref - o.z >= 3 THEN loss + ref - o.z ELSE loss END FROM r JOIN o ON o.line_id = r.line_id AND o.day = r.day AND o.k = r.k + 1)
    SELECT line_id, day, round(any_value(start_m), 1) AS start_m, round(any_value(end_m - start_m), 1) AS distance_m, round(max(gain), 1) AS gain_m, round(max(loss), 1) AS loss_m FROM r JOIN cuts USING (line_id, day) WHERE end_m > start_m GROUP BY line_id, day"""


@query("day_stats", sql(FILL + ", " + DAYS_SQL, "profile").replace("WITH ", "WITH RECURSIVE ", 1))
def day_stats(spark: SparkSession, d: str) -> DataFrame:
    """Length, gain and loss of each day between cuts of a profile smoothed once; the profile is read between samples at the cuts."""
    c = F.col
    profile = smoothed(load(spark, d, "profile"))
    lines = profile.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("along_m", "s"))).alias("v"))  # of one line
    lines = lines.withColumn("len", F.element_at("v", -1)["along_m"]).filter("len > 0")
    days = F.array(*(F.struct(F.lit(k).alias("day"), (c("len") * a).alias("start_m"), (c("len") * b).alias("end_m")) for k, (a, b) in enumerate(zip(CUTS, CUTS[1:], strict=False))))
    days = lines.select("line_id", "v", F.explode(days).alias("d")).select("line_id", "v", "d.*")

    def value(at: Column) -> Column:
        low = F.element_at(F.filter(c("v"), lambda x: x["along_m"] <= at), -1)
        high = F.try_element_at(F.filter(c("v"), lambda x: x["along_m"] > at), F.lit(1))
        return F.when(high.isNull(), low["s"]).otherwise(low["s"] + (high["s"] - low["s"]) * (at - low["along_m"]) / (high["along_m"] - low["along_m"]))

    inside = F.transform(F.filter(c("v"), lambda x: (x["along_m"] > c("start_m")) & (x["along_m"] < c("end_m"))), lambda x: x["s"])
    series = F.concat(F.array(value(c("start_m"))), inside, F.array(value(c("end_m"))))
    climbed = days.select("line_id", "day", "start_m", "end_m", threshold_climb(series, THRESHOLD).alias("climb"))
    return climbed.select("line_id", "day", rounded(c("start_m"), 1).alias("start_m"), rounded(c("end_m") - c("start_m"), 1).alias("distance_m"), rounded(c("climb.gain"), 1).alias("gain_m"), rounded(c("climb.loss"), 1).alias("loss_m"))


def thinned(distances: Column, spacing: float) -> Column:
    """Of ascending values those at least a spacing after the last one kept: how many, and the last."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))
    return F.aggregate(distances, zero, lambda a, x: F.when((a["n"] == 0) | (x - a["last"] >= spacing), F.struct((a["n"] + 1).alias("n"), x.alias("last"))).otherwise(a))


@query("greedy_places", "WITH RECURSIVE p AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS pos, value AS v FROM events), r AS (SELECT line_id, pos, v AS kept, 1 AS n FROM p WHERE pos = 1 UNION ALL SELECT p.line_id, p.pos, CASE WHEN v - kept >= 50 THEN v ELSE kept END, CASE WHEN v - kept >= 50 THEN n + 1 ELSE n END FROM r JOIN p ON p.line_id = r.line_id AND p.pos = r.pos + 1) SELECT line_id, CAST(max(n) AS INT) AS places, round(max(kept), 4) AS last_m FROM r GROUP BY line_id")
def greedy_places(spark: SparkSession, d: str) -> DataFrame:
    kept = load(spark, d, "events").groupBy(F.col("user_id").alias("line_id")).agg(thinned(F.array_sort(F.collect_list("value")), 50.0).alias("kept"))
    return kept.select("line_id", F.col("kept.n").alias("places"), F.round("kept.last", 4).alias("last_m"))


def accepted(track: Column) -> Column:
    """Fixes (t_s, x_m, y_m, accuracy_m) in order -> those kept: accurate to 35 m, and 5 m or 15 s from the last one kept."""
    empty = F.array().cast("array<struct<t_s:bigint,x_m:double,y_m:double>>")

    def step(a: Column, f: Column) -> Column:
        last = F.element_at(a, -1)
        dx, dy = f["x_m"] - last["x_m"], f["y_m"] - last["y_m"]
        fits = (F.size(a) == 0) | (f["t_s"] >= last["t_s"]) & ((F.sqrt(dx * dx + dy * dy) >= 5) | (f["t_s"] - last["t_s"] >= 15))
        return F.when((f["accuracy_m"] <= 35) & fits, F.concat(a, F.array(F.struct(f["t_s"].alias("t_s"), f["x_m"].alias("x_m"), f["y_m"].alias("y_m"))))).otherwise(a)

    return F.aggregate(track, empty, step)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    fixes = load(spark, d, "fixes")
    return fixes.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t_s", "event_id", "x_m", "y_m", "accuracy_m"))).alias("track"))


FIXES = "RECURSIVE fx AS (SELECT track_id, t_s, x_m, y_m, row_number() OVER (PARTITION BY track_id ORDER BY t_s) AS pos FROM fixes WHERE accuracy_m <= 35), r AS (SELECT track_id, pos, t_s AS kt, x_m AS kx, y_m AS ky, 1 AS n FROM fx WHERE pos = 1 UNION ALL SELECT f.track_id, f.pos, CASE WHEN ok THEN t_s ELSE kt END, CASE WHEN ok THEN x_m ELSE kx END, CASE WHEN ok THEN y_m ELSE ky END, CASE WHEN ok THEN n + 1 ELSE n END FROM (SELECT r.kt, r.kx, r.ky, r.n, fx.*, sqrt((x_m - kx) * (x_m - kx) + (y_m - ky) * (y_m - ky)) >= 5 OR t_s - kt >= 15 AS ok FROM r JOIN fx ON fx.track_id = r.track_id AND fx.pos = r.pos + 1) f)"


@query("accepted_fixes", sql(FIXES.removeprefix("RECURSIVE ") + " SELECT track_id, CAST(max(n) AS INT) AS fixes, max(kt) AS last_s FROM r GROUP BY track_id", "fixes").replace("WITH ", "WITH RECURSIVE ", 1))
def accepted_fixes(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("track_id", accepted(F.col("track")).alias("kept")).filter(F.size("kept") > 0).select("track_id", F.size("kept").alias("fixes"), F.element_at("kept", -1)["t_s"].alias("last_s"))


def walked(track: Column) -> Column:
    """Metres of an accepted track: steps of 10 m and more from an anchor, not counted over 7 m/s."""

    def step(a: Column, f: Column) -> Column:
        dx, dy = f["x_m"] - a["x"], f["y_m"] - a["y"]
        far = F.sqrt(dx * dx + dy * dy)
        moves = far >= 10
        slow = far / F.greatest(F.lit(0.001), (f["t_s"] - a["t"]).cast("double")) <= 7
        pick = lambda new, old: F.when(moves, new).otherwise(old)
        return F.struct(pick(f["x_m"], a["x"]).alias("x"), pick(f["y_m"], a["y"]).alias("y"), pick(f["t_s"], a["t"]).alias("t"), F.when(moves & slow, a["m"] + far).otherwise(a["m"]).alias("m"))

    first = F.element_at(track, 1)
    return F.aggregate(track, F.struct(first["x_m"].alias("x"), first["y_m"].alias("y"), first["t_s"].alias("t"), F.lit(0.0).alias("m")), step)["m"]


WALKED = f"{FIXES.removeprefix('RECURSIVE ')}, acc AS (SELECT track_id, n AS pos, any_value(kt) AS t_s, any_value(kx) AS x_m, any_value(ky) AS y_m FROM r GROUP BY track_id, n), w AS (SELECT track_id, pos, x_m AS ax, y_m AS ay, t_s AS since, 0e0 AS metres FROM acc WHERE pos = 1 UNION ALL SELECT track_id, pos, CASE WHEN far >= 10 THEN x_m ELSE ax END, CASE WHEN far >= 10 THEN y_m ELSE ay END, CASE WHEN far >= 10 THEN t_s ELSE since END, CASE WHEN far >= 10 AND far / greatest(0.001, t_s - since) <= 7 THEN metres + far ELSE metres END FROM (SELECT a.*, w.ax, w.ay, w.since, w.metres, sqrt((x_m - ax) * (x_m - ax) + (y_m - ay) * (y_m - ay)) AS far FROM w JOIN acc a ON a.track_id = w.track_id AND a.pos = w.pos + 1)), m AS (SELECT track_id, max(metres) AS metres FROM w GROUP BY track_id), el AS (SELECT track_id, max(t_s) - min(t_s) AS elapsed_s FROM acc GROUP BY track_id) SELECT track_id, round(metres, 3) AS metres, elapsed_s, round(metres / greatest(elapsed_s, 1), 4) AS pace_ms FROM m JOIN el USING (track_id)"


@query("walked_distance", sql(WALKED, "fixes").replace("WITH ", "WITH RECURSIVE ", 1))
def walked_distance(spark: SparkSession, d: str) -> DataFrame:
    kept = tracks(spark, d).select("track_id", accepted(F.col("track")).alias("kept")).filter(F.size("kept") > 0)
    elapsed = F.element_at("kept", -1)["t_s"] - F.element_at("kept", 1)["t_s"]
    return kept.select("track_id", F.round(walked(F.col("kept")), 3).alias("metres"), elapsed.alias("elapsed_s"), F.round(walked(F.col("kept")) / F.greatest(elapsed, F.lit(1)), 4).alias("pace_ms"))


@query("track_segments", "WITH o AS (SELECT user_id AS track_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM o) SELECT track_id, CAST(seg AS BIGINT) AS segment, count(*) AS fixes, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM g GROUP BY ALL")
def track_segments(spark: SparkSession, d: str) -> DataFrame:
    """A new segment after each pause of over twelve hours."""
    w = Window.partitionBy("track_id").orderBy("ts", "event_id")
    fixes = load(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    parts = fixes.withColumn("fresh", F.when(gap <= 12 * 3600 * 1_000_000, 0).otherwise(1)).withColumn("segment", F.sum("fresh").over(w))
    return parts.groupBy("track_id", "segment").agg(F.count(F.lit(1)).alias("fixes"), (F.floor(F.unix_micros(F.max("ts")) / 1e6) - F.floor(F.unix_micros(F.min("ts")) / 1e6)).alias("seconds"))


@query("segment_kinds", "WITH o AS (SELECT user_id AS track_id, event_id, ts, event_type = 'purchase' AS paused, lag(ts) OVER w AS before, lag(event_type) OVER w = 'purchase' AS was_paused FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, CASE WHEN before IS NULL THEN 'start' WHEN was_paused THEN 'resume' WHEN ts - before > INTERVAL 6 HOUR THEN 'gap' END AS kind FROM o) SELECT track_id, kind, count(*) AS segments, min(event_id) AS first_id FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def segment_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How the segments of a track begin: at its start, after a pause that the hiker made, or after a gap in the recording."""
    w = Window.partitionBy("track_id").orderBy("ts", "event_id")
    fixes = load(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    kind = F.when(gap.isNull(), "start").when(F.lag("event_type").over(w) == "purchase", "resume").when(gap > 6 * 3600 * 1_000_000, "gap")
    return fixes.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("track_id", "kind").agg(F.count(F.lit(1)).alias("segments"), F.min("event_id").alias("first_id"))
